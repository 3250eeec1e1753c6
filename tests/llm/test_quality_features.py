"""Features of the quality classifier against plain Python, text by text."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import kernels
from pairloom.llm.quality import KINDS, score_documents, text_features, train_classifier


def kind(byte):
    c = chr(byte)
    if byte >= 128 or "a" <= c <= "z":
        return 0
    for number, members in ((3, " \t\x0b\x0c"), (4, "\n\r"), (5, ".?"), (6, ",;:'-")):
        if c in members:
            return number
    return 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 7


def repeats(items):
    counted = collections.Counter(items)
    return [len(counted) / len(items), max(counted.values()) / len(items)] if items else [1.0, 0.0]


def plain_features(text):
    data = (text or "").encode()
    kinds = [kind(b) for b in data]
    size = max(len(data), 1)
    pairs = collections.Counter(zip(kinds, kinds[1:]))
    single = collections.Counter(kinds)
    out = [math.sqrt(pairs[a, b] / size) for a in range(KINDS) for b in range(KINDS)]
    out += [math.sqrt(single[k] / size) for k in range(KINDS)]
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    n = max(len(words), 1)

    def runs(k):
        return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []

    same = sum(a == b for a, b in zip(words, words[1:]))
    out += [math.log1p(len(words)), (single[0] + single[1]) / n, same / n]
    out.append(math.log1p(single[4]) - math.log1p(len(words)))
    return out + repeats(words) + repeats(runs(2)) + repeats(runs(5))


def test_features_equal_plain_counts():
    pick = random.Random(3)
    pool = ["the", "The", "éa", "x1", "a,b", "end.", "\n", "--", "1234", "𝄞", "same", "same"]
    texts = [None, "", " \n", "one", "One one ONE", "a b c d", "w " * 500]
    texts += [" ".join(pick.choices(pool, k=pick.randint(1, 60))) for _ in range(60)]
    got = text_features(*kernels.text_bytes(pa.array(texts, pa.string())))
    for row, text in zip(got, texts, strict=True):
        assert row == pytest.approx(plain_features(text)), text


def test_held_out_rows_are_not_learnt_from(spark):
    """Neither labels nor texts of the held-out fold change a score."""
    pick = random.Random(9)
    rows = [(i, " ".join(pick.choices("abcdefgh" if i % 2 else "QXZ#", k=30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    first = train_classifier(docs, labels, folds=5, held=0)
    other_text = docs.withColumn("text", F.when(held, "other text").otherwise(F.col("text")))
    second = train_classifier(other_text, labels.where(~held), folds=5, held=0)
    for a, b in zip(first, second, strict=True):
        assert np.array_equal(a, b)
    assert score_documents(docs, first, keep=("doc_id",)).count() == 120
