"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by the non-negative unbiased
risk: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), where pi, the share of positives in unlabelled
text, is estimated first, on halves of the samples that its classifier has not seen. Only
bounded samples (parameters) train; their features, not their texts, come to the driver. Every
text is scored whole, in one pass without a shuffle.

Features of a text describe its form and not its topic: shares of transitions between kinds of
characters, word lengths, and how often words, word pairs and five-word shingles repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import kernels

KINDS = 8
FEATURES = KINDS * KINDS + KINDS + 10
HIDDEN = 24
STEPS = 800
BATCH = 256
RATE = 0.003
DECAY = 0.003


def _kinds() -> np.ndarray:
    """The kind of each byte: letter, capital, digit, blank, line end, stop, comma, other."""
    kind = np.full(256, 7, np.int64)
    kind[list(range(97, 123)) + list(range(128, 256))] = 0
    kind[65:91], kind[48:58] = 1, 2
    kind[[32, 9, 11, 12]], kind[[10, 13]] = 3, 4
    kind[[46, 63]], kind[[44, 59, 58, 39, 45]] = 5, 6
    return kind


def _repeats(values: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: share of distinct values, and share of the most frequent value."""
    n = np.diff(of_text)
    distinct, most = np.ones(len(n)), np.zeros(len(n))
    if len(values):
        text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        keys = np.sort((text << np.uint64(40)) | (values >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        owner = (keys[first] >> np.uint64(40)).astype(np.int64)
        runs = np.diff(np.concatenate([first, [len(keys)]]))
        some = n > 0
        distinct[some] = np.bincount(owner, minlength=len(n))[some] / n[some]
        top = np.zeros(len(n), np.int64)
        np.maximum.at(top, owner, runs)
        most[some] = top[some] / n[some]
    return distinct, most


def text_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of features per text; an empty text has the row of zero lengths."""
    n, size = len(at) - 1, np.diff(at)
    kinds = _kinds()[data]
    text = np.repeat(np.arange(n), size)
    width = KINDS * KINDS
    pairs = np.zeros((n, width))
    if len(data) > 1:
        same = text[1:] == text[:-1]
        code = text[1:] * width + kinds[:-1] * KINDS + kinds[1:]
        pairs = np.bincount(code[same], minlength=n * width).reshape(n, width)
    single = np.bincount(text * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    per_byte = np.maximum(size, 1)[:, None]
    words, of_text = kernels.word_hashes(data, at)
    counts = np.diff(of_text)
    pair_hash, of_pair = kernels.shingles(words, of_text, 2)
    run_hash, of_run = kernels.shingles(words, of_text)
    repeated = [_repeats(words, of_text), _repeats(pair_hash, of_pair), _repeats(run_hash, of_run)]
    next_same = np.zeros(n)
    if len(words) > 1:
        owner = np.repeat(np.arange(n), counts)
        hit = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        next_same = np.bincount(owner[1:][hit], minlength=n) / np.maximum(counts, 1)
    letters = single[:, 0] + single[:, 1]
    columns = [
        np.log1p(counts),
        letters / np.maximum(counts, 1),
        next_same,
        np.log1p(single[:, 4]) - np.log1p(counts),
        *[x for pair in repeated for x in pair],
    ]
    return np.hstack(
        [np.sqrt(pairs / per_byte), np.sqrt(single / per_byte), np.stack(columns, axis=1)]
    )


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    bias: float
    prior: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -4, 4)
        return np.tanh(x @ self.inner + self.inner_bias) @ self.outer + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int = 7) -> list[np.ndarray]:
    """Adam on mini-batches. With a prior: non-negative risk; without: plain P against U.

    The number of steps is the same for every size of the samples.
    """
    random = np.random.default_rng(seed)
    d = p.shape[1]
    weights = [
        random.normal(0, d**-0.5, (d, HIDDEN)),
        np.zeros(HIDDEN),
        random.normal(0, HIDDEN**-0.5, HIDDEN),
        np.zeros(1),
    ]
    first, second = [0 * w for w in weights], [0 * w for w in weights]
    for step in range(1, STEPS + 1):
        drawn_p, drawn_u = random.integers(0, len(p), BATCH), random.integers(0, len(u), BATCH)
        x = np.vstack([p[drawn_p], u[drawn_u]])
        hidden = np.tanh(x @ weights[0] + weights[1])
        z = hidden @ weights[2] + weights[3][0]
        s, n = _sigmoid(z), BATCH
        grad = np.empty(len(z))
        if prior is None:
            grad[:n], grad[n:] = (s[:n] - 1) / n, s[n:] / n
        else:
            losses = np.logaddexp(0, z)
            negative = losses[n:].mean() - prior * losses[:n].mean()
            if negative >= 0:
                grad[:n], grad[n:] = -prior / n, s[n:] / n
            else:
                grad[:n], grad[n:] = prior * s[:n] / n, -s[n:] / n
        back = np.outer(grad, weights[2]) * (1 - hidden**2)
        grads = [x.T @ back, back.sum(0), hidden.T @ grad, np.array([grad.sum()])]
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for i, g in enumerate(grads):
            g = g + DECAY * weights[i] if weights[i].size > HIDDEN or i == 2 else g
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    return weights


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of U to P above a score.

    Above a score that only positives reach, U has pi times the share that P has. Scores that
    few positives reach are left out, and the ratio carries its sampling error.
    """
    cuts = np.quantile(score_p, np.linspace(0.0, 0.8, 41))
    tail = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    in_p, in_u = tail(score_p), tail(score_u)
    slack = np.sqrt(1 / len(score_p)) + np.sqrt(1 / len(score_u))
    best = int(np.argmin((in_u + slack) / in_p))
    return float(np.clip(in_u[best] / in_p[best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """The model, or None where either sample is empty."""
    if not len(positive) or not len(unlabelled):
        return None
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p = np.clip((positive - mean) / scale, -4, 4)
    u = np.clip((unlabelled - mean) / scale, -4, 4)

    def logits(weights, x):
        return np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3][0]

    estimates = []
    for half in (0, 1):
        own_p, own_u = p[half::2], u[half::2]
        other_p, other_u = p[1 - half :: 2], u[1 - half :: 2]
        if len(own_p) and len(own_u) and len(other_p) and len(other_u):
            plain = _train(own_p, own_u, None)
            estimates.append(estimate_prior(logits(plain, other_p), logits(plain, other_u)))
    prior = float(np.mean(estimates)) if estimates else 0.5
    inner, inner_bias, outer, bias = _train(p, u, prior)
    return Model(mean, scale, inner, inner_bias, outer, float(bias[0]), prior)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids are in none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, features: of the sampled rows only."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                rows = text_features(*kernels.text_bytes(part.column("text")))
                cells = pa.FixedSizeListArray.from_arrays(
                    pa.array(rows.astype(np.float32).ravel()), FEATURES
                ).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), cells], ["doc_id", "features"]
                )

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, features array<float>")


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of at most ``most`` of the ids, the first by hash; the same in every run.

    An id with several rows counts once, by the text with the least hash.
    """
    chosen = ids.distinct().orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)
    kept = docs.where("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id", "left_semi")
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    kept = kept.groupBy("doc_id").agg(least["text"].alias("text"))
    rows = _features(kept).toArrow()
    if not rows.num_rows:
        return np.zeros((0, FEATURES))
    flat = rows["features"].combine_chunks().flatten().to_numpy().astype(float)
    table = flat.reshape(-1, FEATURES)
    return table[np.lexsort([*table.T[:4], rows["doc_id"].to_numpy()])]


def train_classifier(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = 20_000
) -> Model | None:
    """Fit on at most ``most`` trusted positives and as many unlabelled documents.

    Only ids outside fold ``held`` are looked at, in both tables. A positive is an id all of
    whose label rows say quality 1; unlabelled is an id without any label row. Label rows with
    nulls are no labels.
    """
    outside = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held)
    seen = labels.where(outside)
    good = (
        seen.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = 1 AND high = 1")
        .select("doc_id")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = texts.select("doc_id").where(outside)
    named = seen.select(F.col("doc_id").cast("long").alias("doc_id"))
    return fit(
        _sample(texts, good.join(ids, "doc_id", "left_semi"), most),
        _sample(texts, ids.join(named, "doc_id", "left_anti"), most),
    )


def score_documents(
    docs: DataFrame, model: Model | None, threshold: float = 0.3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Columns ``keep`` of every row with ``score`` (0 to 1) and ``predicted`` (0 or 1).

    Scores depend on the text alone. A null text counts as empty; an empty text has the score
    of its (zero) features. Without a model (no positives or no unlabelled rows) every score is
    0.5. Input columns not named in ``keep`` are left out; repeated rows stay.
    """
    chosen = docs.select(*keep, *([] if "text" in keep else ["text"]))
    names = [*keep, "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                if model is None:
                    score = np.full(part.num_rows, 0.5)
                else:
                    bytes_at = kernels.text_bytes(part.column("text"))
                    score = _sigmoid(model.logits(text_features(*bytes_at)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(score)], names
                )

    kept = chosen.select(*keep).schema if keep else None
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] if kept else []
    out = chosen.mapInArrow(scored, ", ".join([*fields, "score double"]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
