"""License scan against every block and every template in plain Python."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm.licenses import PHRASES, TEMPLATES, scan_licenses, scan_words, size_class
from pairloom.llm import kernels

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(text, templates, phrases, least):
    w = words(text)
    places, base, best = [], set(), 0.0
    for phrase, label in phrases:
        p = words(phrase)
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += own
        if own:
            base.add(label)
            best = 1.0
    found = set(base)
    for label, notice in templates:
        t = words(notice)
        if not t:
            continue
        s = size_class(len(t))
        for start in range(0, max(1, len(w)), s):
            share = len(set(t) & set(w[start : start + 2 * s])) / len(set(t))
            if share >= least - 1e-9:
                found.add(label)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(found)), best)


def texts(seed):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = [None, "", "mit license", "MIT-License, mit  LICENSE\x00mit license", "é mit licenseé", "cc by cc by"]
    for _, notice in TEMPLATES:
        w = notice.split()
        for drop in (0, 1, 2, len(w) // 5, len(w) // 3):
            kept = list(w)
            for _ in range(drop):
                kept.pop(pick.randrange(len(kept)))
            around = pick.choices(vocabulary, k=pick.randint(0, 300))
            cut = pick.randint(0, len(around))
            out.append(" ".join(around[:cut] + kept + around[cut:]))
            out.append(" ".join(pick.sample(kept, len(kept))))
    return out + [" ".join(pick.choices(vocabulary, k=20_000)), "license " * 3000]


@pytest.mark.parametrize("least", [0.8, 0.5, 1.0])
def test_scan_equals_brute_force(spark, least):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts(int(least * 10)))]
    rows += rows[5:8]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_words", "labels", "word", "score"):
        frame = frame.withColumn(name, F.lit("clash"))
    more = (*TEMPLATES, ("one", "w1"), ("three", "w1 w2 w3"), ("none", ""))
    got = scan_licenses(frame, more, PHRASES, least).collect()
    want = [(d, *brute(t, more, PHRASES, least)) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_templates_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(none).count() == 0
    one = spark.createDataFrame([(1, "an MIT license")], "doc_id long, text string")
    assert tuple(scan_licenses(one, templates=()).first()) == (1, 3, 1, 1, 1, "mit", "mit", 1.0)
    assert scan_licenses(one, phrases=()).first().labels == ""


def test_words_are_those_of_the_pattern():
    odd = "".join(map(chr, range(256))) + " A1é-b_c.𝄞x"
    n = [len(scan_words(*kernels.text_bytes(pa.array([t])))[0]) for t in (odd, "", "--")]
    assert n == [len(words(odd)), 0, 0]
