"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

Items come in blocks of a bounded number; each block is one pass over the documents. In a pass
every text is cut into five-word shingles, whole. Windows as long as an item that hold at least
one of its shingles (others cannot be similar) get a 256-bit SimHash, taken from running sums of
the shingles' bit votes. Fingerprints lie in 16 blocks of 16 bits: two that differ in at most 63
bits differ in at most 3 bits of some block, so a table of every item block with up to 3 bits
flipped finds all items within the radius. Those are verified by the exact weighted Jaccard
similarity of window and item.

A pair of similarity 0.8 has fingerprints 39 +- 6 bits apart, a verbatim copy 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import kernels
from pairloom.llm.minhash import node_of
from pairloom.session import materialize

ITEMS_A_PASS = 400
BITS = 256
BLOCKS = 16
FLIPS = 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
WINDOWS_AT_ONCE = 4096


class ItemIndex(NamedTuple):
    """Items of one pass: their shingles, fingerprints and the table of flipped blocks."""

    ids: np.ndarray
    words: np.ndarray
    shingles: list[np.ndarray]
    prints: np.ndarray
    known: np.ndarray
    known_at: np.ndarray
    known_items: np.ndarray
    cells: np.ndarray
    cell_items: np.ndarray


def votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    seeds = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    bits = kernels.mix(shingles[:, None] ^ seeds)
    ones = np.unpackbits(bits.view(np.uint8).reshape(len(shingles), -1), axis=1)
    return ones.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Signs of the summed votes as rows of 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def item_shingles(words: np.ndarray) -> np.ndarray:
    return kernels.shingles(words, np.array([0, len(words)]))[0]


def build_index(items: list[tuple[int | None, str | None]]) -> ItemIndex | None:
    """Index the items that have words; None if there are none."""
    texts = pa.array([t for _, t in items], pa.string())
    words, at = kernels.word_hashes(*kernels.text_bytes(texts))
    full = [i for i in range(len(items)) if at[i + 1] > at[i]]
    if not full:
        return None
    own = [item_shingles(words[at[i] : at[i + 1]]) for i in full]
    prints = np.vstack([fingerprints(votes(s).sum(axis=0, keepdims=True)) for s in own])
    owner = np.repeat(np.arange(len(full)), [len(s) for s in own])
    pairs = np.unique(np.stack([np.concatenate(own), owner.astype(np.uint64)]), axis=1)
    known, first = np.unique(pairs[0], return_index=True)
    flips = [0] + [
        sum(1 << b for b in bits)
        for n in range(1, FLIPS + 1)
        for bits in combinations(range(16), n)
    ]
    near = prints[:, :, None].astype(np.int32) ^ np.array(flips, np.int32)
    cells = (near + (np.arange(BLOCKS, dtype=np.int32) << 16)[None, :, None]).reshape(len(full), -1)
    order = np.argsort(cells, axis=None, kind="stable")
    return ItemIndex(
        np.array([-1 if items[i][0] is None else items[i][0] for i in full]),
        np.array([at[i + 1] - at[i] for i in full]),
        own,
        prints,
        known,
        np.append(first, pairs.shape[1]),
        pairs[1].astype(np.int64),
        cells.ravel()[order],
        (order // cells.shape[1]).astype(np.int32),
    )


def within_radius(index: ItemIndex, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (fingerprint, item) index pairs at most RADIUS bits apart, by the table."""
    cells = prints.astype(np.int32) + (np.arange(BLOCKS, dtype=np.int32) << 16)
    low = np.searchsorted(index.cells, cells, "left").ravel()
    n = np.searchsorted(index.cells, cells, "right").ravel() - low
    row = np.repeat(np.arange(len(prints)), n.reshape(cells.shape).sum(axis=1))
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    pair = np.unique(row * len(index.ids) + index.cell_items[at])
    row, item = pair // len(index.ids), pair % len(index.ids)
    apart = np.bitwise_count(prints[row] ^ index.prints[item]).sum(axis=1)
    return row[apart <= RADIUS], item[apart <= RADIUS]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    values_a, n_a = np.unique(a, return_counts=True)
    values_b, n_b = np.unique(b, return_counts=True)
    _, in_a, in_b = np.intersect1d(values_a, values_b, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n_a[in_a], n_b[in_b]).sum())
    total = len(a) + len(b) - shared
    return shared / total if total else 0.0


def _shingle_items(index: ItemIndex, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, item) of every shingle that an item has."""
    at = np.minimum(np.searchsorted(index.known, shingles), len(index.known) - 1)
    place = np.flatnonzero(index.known[at] == shingles)
    low, high = index.known_at[at[place]], index.known_at[at[place] + 1]
    n = high - low
    item = index.known_items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    return np.repeat(place, n), item


def text_matches(index: ItemIndex, words: np.ndarray, least: float) -> dict[int, float]:
    """Items similar to some window of one text, with the best similarity."""
    best: dict[int, float] = {}
    lengths = np.unique(index.words)
    for length in lengths[lengths < kernels.SHINGLE]:
        _short_matches(index, words, int(length), best)
    long_items = np.flatnonzero(index.words >= kernels.SHINGLE)
    if len(words) < kernels.SHINGLE or not len(long_items):
        return best
    shingles = item_shingles(words)
    place, item = _shingle_items(index, shingles)
    for length in np.unique(index.words[item]):
        if length < kernels.SHINGLE:
            continue
        width = min(int(length) - kernels.SHINGLE + 1, len(shingles))
        last = len(shingles) - width
        marked = np.zeros(len(shingles) + 1, np.int64)
        hits = place[index.words[item] == length]
        np.add.at(marked, np.maximum(hits - width + 1, 0), 1)
        np.add.at(marked, hits + 1, -1)
        starts = np.flatnonzero(np.cumsum(marked)[: last + 1] > 0)
        for first in range(0, len(starts), WINDOWS_AT_ONCE):
            part = starts[first : first + WINDOWS_AT_ONCE]
            covered = np.unique((part[:, None] + np.arange(width)).ravel())
            sums = np.zeros((len(covered) + 1, BITS), np.int32)
            np.cumsum(votes(shingles[covered]), axis=0, out=sums[1:])
            begin = np.searchsorted(covered, part)
            prints = fingerprints(sums[begin + width] - sums[begin])
            for row, found in zip(*within_radius(index, prints), strict=True):
                if index.words[found] == length:
                    window = shingles[part[row] : part[row] + width]
                    score = weighted_similarity(window, index.shingles[found])
                    if score >= least and score > best.get(int(found), 0.0):
                        best[int(found)] = score
    return best


def _short_matches(index: ItemIndex, words: np.ndarray, length: int, best: dict[int, float]) -> None:
    """Items of fewer than five words: their one shingle is the run of all their words."""
    if len(words) < length:
        return
    weights = kernels.powers(np.uint64(0xC2B2AE3D27D4EB4F), kernels.SHINGLE)
    runs = np.full(len(words) - length + 1, length, np.uint64)
    for j in range(length):
        runs += words[j : j + len(runs)] * weights[j]
    runs = kernels.mix(runs)
    for found in np.flatnonzero(index.words == length):
        if np.any(runs == index.shingles[found][0]):
            best[int(found)] = 1.0


def _pass_over(docs: DataFrame, index: ItemIndex, least: float) -> DataFrame:
    """doc_id, node, item_id, similarity of the documents that match an item of the index."""
    short = [int(n) for n in np.unique(index.words) if n < kernels.SHINGLE]
    # Plain arrays, as a class of this package is not known to the workers.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(index))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("item_id", pa.int64()), ("similarity", pa.float64())]
    )

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*shared.value)
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                words, of_text = kernels.word_hashes(*kernels.text_bytes(part.column("text")))
                hashes, of_run = kernels.shingles(words, of_text)
                at = np.minimum(np.searchsorted(index.known, hashes), len(index.known) - 1)
                hit = np.searchsorted(of_run, np.flatnonzero(index.known[at] == hashes), "right") - 1
                some = np.arange(part.num_rows) if short else np.unique(hit)
                rows = []
                for i in some:
                    own = words[of_text[i] : of_text[i + 1]]
                    for item, score in text_matches(index, own, least).items():
                        doc, text = (part.column(c)[int(i)].as_py() for c in (0, 1))
                        rows.append((doc, text, int(index.ids[item]), score))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                        schema=schema,
                    )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        matched, "doc_id long, text string, item_id long, similarity double"
    )
    return found.select("doc_id", node_of(F.col("text")).alias("node"), "item_id", "similarity")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, node, item_id, similarity: every document with a window similar to an item.

    The benchmark may be of any size: it is read in blocks of about ITEMS_A_PASS items, each a
    broadcast of bounded number and one pass. Items without words match nothing; a null item_id
    is shown as -1. Copies of a row give one result.
    """
    items = materialize(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "items"
    )
    blocks = max(1, -(-items.count() // ITEMS_A_PASS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out: DataFrame | None = None
    for i in range(blocks):
        rows = items.where(block == i).orderBy("item_id", "text").toArrow().to_pylist()
        index = build_index([(r["item_id"], r["text"]) for r in rows])
        if index is not None:
            found = materialize(_pass_over(docs, index, least), "matches")
            out = found if out is None else out.union(found)
    if out is None:
        out = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            node_of(F.col("text")).alias("node"),
            F.lit(0).cast("long").alias("item_id"),
            F.lit(0.0).alias("similarity"),
        ).where(F.lit(False))
    return out.groupBy("doc_id", "node", "item_id").agg(F.max("similarity").alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, contaminated, n_items, items, similarity.

    ``items`` lists the matching item ids in order, ``similarity`` is the best (0 if none). A
    window is as long as the item, or the whole text where that is shorter. Null and empty
    texts, and texts without words, match nothing; null and repeated ids keep their rows; other
    columns are left out. Case of A-Z is folded.
    """
    flags = (
        benchmark_matches(docs, benchmark, least)
        .groupBy("doc_id", "node")
        .agg(
            F.sort_array(F.collect_set("item_id")).alias("items"),
            F.max("similarity").alias("similarity"),
        )
        .toDF("_id", "_node", "items", "similarity")
    )
    flags = materialize(flags, "flags")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"))
    same = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    items = F.coalesce("items", F.array().cast("array<long>"))
    return rows.join(flags, same, "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, columns: tuple[str, ...] = ()
) -> DataFrame:
    """The ``columns`` of the rows of ``docs`` that match no item of the benchmark."""
    found = benchmark_matches(docs, benchmark, least).select("doc_id", "node").distinct()
    found = materialize(found.toDF("_id", "_found"), "flags")
    rows = docs.select(*columns, node_of(F.col("text")).alias("_node"))
    same = (F.col("_node") == F.col("_found")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    return rows.join(found, same, "left_anti").select(*columns)
