"""BLEU and chrF against short counters, and their edges."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import metrics
from pairloom.operators.ngrams import count_matches


def grams(units, n):
    return Counter(tuple(units[i:i + n]) for i in range(len(units) - n + 1))


def brute_bleu(pairs):
    match, total = [0] * 4, [0] * 4
    c = r = 0
    for pred, refs in pairs:
        c += len(pred)
        r += min(len(x) for x in refs)
        for n in range(1, 5):
            best = Counter()
            for ref in refs:
                best |= grams(ref, n)
            match[n - 1] += sum((grams(pred, n) & best).values())
            total[n - 1] += max(0, len(pred) - n + 1)
    p = [m / t if t else 0.0 for m, t in zip(match, total)]
    if min(p) == 0:
        return 0.0
    bp = 1.0 if c > r else math.exp(1 - r / c)
    return bp * math.exp(sum(math.log(x) for x in p) / 4)


def brute_chrf(pairs):
    sums = [[0, 0, 0] for _ in range(6)]
    for pred, ref in pairs:
        pred, ref = "".join(pred.split()), "".join(ref.split())
        for n in range(1, 7):
            a, b = grams(pred, n), grams(ref, n)
            s = sums[n - 1]
            s[0] += sum((a & b).values())
            s[1] += sum(a.values()) if b else 0
            s[2] += sum(b.values())
    used = [s for s in sums if s[1] and s[2]]
    if not used:
        return 0.0
    p = sum(s[0] / s[1] for s in used) / len(used)
    r = sum(s[0] / s[2] for s in used) / len(used)
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


def frame(spark, pairs):
    rows = [(str(i), p, r) for i, (p, r) in enumerate(pairs)]
    return spark.createDataFrame(rows, "pair_id string, prediction string, reference string")


TEXTS = [
    ("the the the cat", "the cat sat on the mat"),
    ("a b c d e f", "a b c d e f"),
    ("", "nothing was said"),
    ("one", "one"),
    ("naïve café 😀 😀 x", "café naïve 😀 y x"),
    ("word", ""),
    ("", ""),
]


def test_equals_brute_force(spark):
    random.seed(1)
    pairs = TEXTS + [
        (" ".join(random.choices("abcde", k=random.randint(0, 15))),
         " ".join(random.choices("abcde", k=random.randint(0, 15))))
        for _ in range(40)
    ]
    row = metrics.all_metrics(frame(spark, pairs)).first()
    assert row["n_segments"] == len(pairs)
    assert row["bleu"] == pytest.approx(brute_bleu([(p.split(), [r.split()]) for p, r in pairs]), abs=1e-8)
    assert row["chrf"] == pytest.approx(brute_chrf(pairs), abs=1e-8)


def test_several_references(spark):
    pairs = [("the cat is here now", ["the cat is there now", "a cat is here"]),
             ("the the the the", ["the dog the end", "the the cat sat"])]
    df = spark.createDataFrame(
        [(str(i), p, r) for i, (p, r) in enumerate(pairs)],
        "pair_id string, prediction string, reference array<string>",
    )
    got = metrics.corpus_bleu(df).first()
    expected = brute_bleu([(p.split(), [x.split() for x in r]) for p, r in pairs])
    assert got["bleu"] == pytest.approx(expected, abs=1e-8)
    with pytest.raises(ValueError):
        metrics.corpus_chrf(df)


def test_identical_and_empty(spark):
    same = metrics.all_metrics(frame(spark, [("a b c d", "a b c d"), ("e f g h", "e f g h")])).first()
    assert (same["bleu"], same["chrf"]) == (1.0, 100.0)
    empty = metrics.all_metrics(frame(spark, [("", "a b"), ("", "c")])).first()
    assert (empty["bleu"], empty["chrf"]) == (0.0, 0.0)


def test_per_evaluation_and_segment(spark):
    df = frame(spark, TEXTS)
    both = df.withColumn("run", F.lit(1)).unionByName(
        df.withColumn("run", F.lit(2)).withColumn("prediction", F.col("reference"))
    )
    by_run = {r["run"]: r for r in metrics.all_metrics(both, ["run"]).collect()}
    alone = metrics.all_metrics(df).first()
    assert by_run[1]["chrf"] == alone["chrf"] and by_run[1]["n_segments"] == len(TEXTS)
    assert by_run[2]["chrf"] == 100.0
    scores = metrics.segment_scores(df).collect()
    assert len(scores) == len(TEXTS)
    for r in scores:
        p, ref = TEXTS[int(r["pair_id"])]
        assert r["chrf"] == pytest.approx(brute_chrf([(p, ref)]), abs=1e-8)


def test_partition_number_is_free(spark):
    df = frame(spark, TEXTS * 3).withColumn("pair_id", F.monotonically_increasing_id().cast("string"))
    assert metrics.all_metrics(df.repartition(1)).first() == metrics.all_metrics(df.repartition(7)).first()


def test_slices_of_a_batch(monkeypatch):
    from pairloom.operators import ngrams

    random.seed(2)
    p = ["".join(random.choices("abé😀", k=random.randint(0, 30))) for _ in range(50)]
    r = ["".join(random.choices("abé😀", k=random.randint(0, 30))) for _ in range(50)]
    whole = count_matches(pa.array(p), pa.array(r), 6)
    monkeypatch.setattr(ngrams, "SLICE_UNITS", 40)
    cut = count_matches(pa.array(p), pa.array(r), 6)
    assert all((a == b).all() for a, b in zip(whole, cut))
    for i in range(50):
        for n in range(1, 7):
            assert whole[0][n - 1, i] == sum((grams(p[i], n) & grams(r[i], n)).values())


def brute_13a(s):
    s = s.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = s.replace(a, b)
    s = f" {s} "
    for pattern, put in text.PATTERNS_13A:
        s = re.sub(pattern, put.replace("$", "\\"), s)
    return s.split()


def test_13a_and_space(spark):
    cases = [
        "Hello, world! It's 3.14 - or 1,000.", "a-\nb", "x<skipped>y", "&quot;q&quot; &amp;lt;",
        "end.", "5-6 a-b", "non breaking space\x0bvt\x85nel", "café ÅÄÖ 😀!", "", "  \n ",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    for r in df.select("i", text.tokens_13a(F.col("c")).alias("t"), text.words(F.col("c")).alias("w"),
                       text.strip(F.col("c")).alias("s")).collect():
        assert r["t"] == brute_13a(cases[r["i"]])
        assert r["w"] == cases[r["i"]].split()
        assert r["s"] == cases[r["i"]].strip()


def test_score_mean_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "score double")
    assert tuple(metrics.score_mean_std(df, "score").first()) == (2.0, 1.0)
    assert tuple(metrics.score_mean_std(df.limit(0), "score").first()) == (0.0, 0.0)


def test_packed_ngrams_and_their_fallback_match_brute_force():
    from pairloom.operators import ngrams

    rng = random.Random(7)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 2000)))  # six of these need more than 64 bits
    packed = []
    for letters in ("ab", "abc de.,-0", wide):
        p, r = (
            ["".join(rng.choices(letters, k=rng.choice([0, 1, 5, 6, 7, 90]))) for _ in range(40)]
            for _ in range(2)
        )
        codes, lengths = ngrams.CODES["char"](p + r)
        packed.append(ngrams._packed_matches(codes, lengths, len(p), 6) is not None)
        for unit, orders, split in (("char", 6, lambda t: "".join(t.split())), ("word", 4, ngrams.words_13a)):
            found, n_p, _ = count_matches(pa.array(p), pa.array(r), orders, unit)
            for i, (a, b) in enumerate(zip(map(split, p), map(split, r))):
                assert n_p[i] == len(a)
                for n in range(1, orders + 1):
                    assert found[n - 1, i] == sum((grams(a, n) & grams(b, n)).values())
    assert packed == [True, True, False]


def test_13a_words_in_tasks_are_those_of_the_column(spark):
    texts = ["a.b, c 1.5 x-y 2-3 <skipped>&amp;", " \x85(é)\u3000-\nz . , 7,", "", "!~`'", "..,, 1,.,2 -"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.tokens_13a(F.col("t")).alias("w"))
    from pairloom.operators.ngrams import words_13a

    assert {r.t: r.w for r in rows.collect()} == {t: words_13a(t) for t in texts}


def test_a_text_of_several_pairs_is_cut_once(monkeypatch):
    """Each line is the reference of one pair and the prediction of the next."""
    from pairloom.operators import ngrams

    rng = random.Random(8)
    lines = ["".join(rng.choices("ab .,-1!é& ", k=rng.choice([0, 5, 40]))) + f" w{i}" for i in range(60)]
    seen = []
    for unit, orders in (("word", 4), ("char", 6)):
        cut = ngrams.CODES[unit]
        monkeypatch.setitem(ngrams.CODES, unit, lambda texts, cut=cut: seen.extend(texts) or cut(texts))
        split = ngrams.words_13a if unit == "word" else lambda t: "".join(t.split())
        found, n_p, n_r = count_matches(pa.array(lines[:-1]), pa.array(lines[1:]), orders, unit)
        for i, (a, b) in enumerate(zip(map(split, lines[:-1]), map(split, lines[1:]))):
            assert (n_p[i], n_r[i]) == (len(a), len(b))
            for n in range(1, orders + 1):
                assert found[n - 1, i] == sum((grams(a, n) & grams(b, n)).values())
    assert sorted(seen) == sorted(lines * 2)


def test_words_of_a_slice_are_those_of_the_patterns():
    from pairloom.operators import ngrams

    rng = random.Random(9)
    parts = ["a", "1", ".", ",", "-", " ", " ", "\x1c", "&quot;", "&lt;", "<skipped>", "-\n", "\n", "é", "!", "'", "\\"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]

    def plain(text):
        for found, put in ngrams.LITERALS_13A:
            text = text.replace(found, put)
        text = f" {text} "
        for pattern, put in ngrams._PATTERNS:
            text = pattern.sub(put, text)
        return text.split()

    assert [t.split() for t in ngrams._spaced(texts)] == [plain(t) for t in texts]
