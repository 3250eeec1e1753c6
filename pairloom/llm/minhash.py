"""Near-duplicate documents by DartMinHash signatures.

A document is the weighted set of its five-word shingles; a shingle weighs as often as it
occurs. Darts fall on the region under each weight, one axis being a random rank: within a unit
of weight they arrive as a Poisson process that only the hash of the shingle and of the unit
decides, so equal parts of two documents get equal darts. A document of total weight W looks at
ranks up to t / W, about t darts whatever its length. Each dart belongs to one of K coordinates;
the earliest of a coordinate is its signature there. Two documents agree on a coordinate with
the probability of their weighted Jaccard similarity.

Documents that agree on all coordinates of a band meet in a bucket and are compared by their
exact weighted similarity. Copies of one text are one node throughout. A bucket is not expanded
into all pairs: its members are held against one of them first, and only pairs whose ends are
still in different components follow, so a large group of near copies costs about one comparison
a member, and no link that could join two components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import kernels
from pairloom.llm.components import components
from pairloom.session import materialize

# 40 bands of 6: a pair of similarity 0.8 shares no band once in 190,000 times.
BANDS = 40
ROWS = 6
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (math.log(COORDINATES) + 3)
MANY_DARTS = 32.0
# A text takes about DARTS darts however short it is, so texts a slice are bounded beside bytes.
SLICE_TEXTS = 256
# Buckets of up to so many members are compared pair by pair, larger ones in pieces.
SMALL_BUCKET = 8
PIECE_ROWS = 256
PIECE_WEIGHT = 500_000.0


def bag_weights(
    hashes: np.ndarray, of_text: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values of each text in order, their texts, and how often each occurs."""
    text = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
    order = np.lexsort((hashes, text))
    value = hashes[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(first)
    return value[starts], text[starts], np.diff(np.append(starts, len(value)))


def weight_units(
    values: np.ndarray, text: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The region under each weight cut at whole numbers: hash, text, height of each piece."""
    n = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(values)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    units = kernels.mix(values[owner] + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return units, text[owner], np.minimum(weights[owner] - nth, 1.0)


def _gap(units: np.ndarray, nth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and exponential gap of the nth dart of each unit."""
    step = np.asarray(nth, np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)
    dart = kernels.mix(units ^ step)
    return dart, -np.log(kernels.unit(dart))


def throw_darts(
    units: np.ndarray, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit index, hash and rank of all darts with a rank below their unit's limit."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_at = np.flatnonzero(limit <= MANY_DARTS)
    rank, nth = np.zeros(len(open_at)), 0
    while len(open_at):
        dart, gap = _gap(units[open_at], nth)
        rank = rank + gap
        hit = rank < limit[open_at]
        open_at, rank, nth = open_at[hit], rank[hit], nth + 1
        found.append((open_at, dart[hit], rank))
    open_at = np.flatnonzero(limit > MANY_DARTS)
    reach = limit[open_at]
    draws = (reach + 8 * np.sqrt(reach) + 8).astype(np.int64)
    while len(open_at):
        ends = np.cumsum(draws)
        owner = np.repeat(np.arange(len(open_at)), draws)
        nth = np.arange(ends[-1]) - np.repeat(ends - draws, draws)
        dart, gap = _gap(units[open_at][owner], nth)
        total = np.cumsum(gap)
        before = np.concatenate([[0.0], total])[ends - draws]
        rank = total - before[owner]
        complete = rank[ends - 1] >= limit[open_at]
        hit = (rank < limit[open_at][owner]) & complete[owner]
        found.append((open_at[owner[hit]], dart[hit], rank[hit]))
        open_at, draws = open_at[~complete], draws[~complete] * 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def signatures(hashes: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """K values per text and its total weight; rows of texts without shingles are zero."""
    n = len(of_text) - 1
    out = np.zeros((n, COORDINATES), np.uint64)
    values, owner, counts = bag_weights(hashes, of_text)
    units, text, height = weight_units(values, owner, counts.astype(np.float64))
    weight = np.bincount(text, weights=height, minlength=n)
    open_texts, darts = np.flatnonzero(weight), DARTS
    while len(open_texts):
        place = np.full(n, -1)
        place[open_texts] = np.arange(len(open_texts))
        mine = place[text] >= 0
        own_units, own_text, own_height = units[mine], place[text[mine]], height[mine]
        at, dart, rank = throw_darts(own_units, darts / weight[open_texts][own_text])
        under = kernels.unit(kernels.mix(dart + np.uint64(7))) < own_height[at]
        at, dart, rank = at[under], dart[under], rank[under]
        cell = own_text[at] * COORDINATES + (
            kernels.mix(dart + np.uint64(11)) % np.uint64(COORDINATES)
        ).astype(np.int64)
        best = np.full(len(open_texts) * COORDINATES, np.inf)
        np.minimum.at(best, cell, rank)
        first = rank == best[cell]
        drawn = np.zeros(len(best), np.uint64)
        drawn[cell[first]] = dart[first]
        full = np.isfinite(best).reshape(-1, COORDINATES).all(axis=1)
        out[open_texts[full]] = drawn.reshape(-1, COORDINATES)[full]
        open_texts, darts = open_texts[~full], darts * 2
    return out, weight


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    keys = (parts * kernels.powers(np.uint64(0x9E3779B97F4A7C15), ROWS)).sum(axis=2, dtype=np.uint64)
    return kernels.mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def pack_bag(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Values as 40-bit numbers in order and their counts, byte by byte of all."""
    short = values >> np.uint64(24)
    high = (short >> np.uint64(32)).astype(np.uint8)
    return high.tobytes() + short.astype("<u4").tobytes() + counts.astype("<u4").tobytes()


def unpack_bag(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 9
    high = np.frombuffer(packed, np.uint8, n).astype(np.uint64) << np.uint64(32)
    values = high | np.frombuffer(packed, "<u4", n, n)
    return values, np.frombuffer(packed, "<u4", n, 5 * n).astype(np.float64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed documents."""
    values_a, weight_a = unpack_bag(a)
    values_b, weight_b = unpack_bag(b)
    both = np.concatenate([values_a, values_b])
    order = np.argsort(both, kind="stable")
    weight = np.concatenate([weight_a, weight_b])[order]
    pair = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    shared = np.minimum(weight[pair], weight[pair + 1]).sum()
    total = weight.sum() - shared
    return float(shared / total) if total else 0.0


def node_of(text: Column | str) -> Column:
    """The node of a text: all copies of it share one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _text_shingles(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    words, of_text = kernels.word_hashes(*kernels.text_bytes(part.column(column)))
    return kernels.shingles(words, of_text)


def signed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, node, weight, keys (one per band; none for a text without words)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text", rows=SLICE_TEXTS):
                hashes, of_text = _text_shingles(part, "text")
                count = np.diff(of_text)
                signature, weight = signatures(hashes, of_text)
                keys = band_keys(signature).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum((count > 0) * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys[count > 0].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("node"), pa.array(weight), lists],
                    ["doc_id", "node", "weight", "keys"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), "text"
    )
    return rows.mapInArrow(signed, "doc_id long, node binary, weight double, keys array<long>")


def packed_documents(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, bag, sketch, keys, one row for each of ``nodes`` (node, doc_id, n_rows).

    The sketch is the lowest byte of each coordinate of the signature.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text", rows=SLICE_TEXTS):
                hashes, of_text = _text_shingles(part, "text")
                values, text, counts = bag_weights(hashes, of_text)
                at = np.searchsorted(text, np.arange(part.num_rows + 1))
                cells = [
                    pack_bag(values[i:j], counts[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)
                ]
                signature, _ = signatures(hashes, of_text)
                columns = [
                    cells,
                    [r.tobytes() for r in signature.astype(np.uint8)],
                    [r.tobytes() for r in band_keys(signature)],
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        part.column("n_rows"),
                        *[pa.array(c, pa.binary()) for c in columns],
                    ],
                    ["node", "n_rows", "bag", "sketch", "keys"],
                )

    wanted = nodes.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), "n_rows")
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), "text"
    ).join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    stored = materialize(
        chosen.select("node", "n_rows", "text").mapInArrow(
            packed, "node binary, n_rows long, bag binary, sketch binary, keys binary"
        ),
        "bags",
    )
    once = stored.where("n_rows = 1").drop("n_rows")
    return once.union(stored.where("n_rows > 1").drop("n_rows").dropDuplicates(["node"]))


def compared(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b), those at least ``least`` similar."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column("bag_a"), batch.column("bag_b")
            hit = [
                similarity(first[i].as_py(), second[i].as_py()) >= least
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return (
        pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
        .join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
        .select("a", "b", "bag_a", "bag_b")
        .mapInArrow(linked, "a binary, b binary")
    )


def _near_size(least: float) -> Column:
    """Sizes too far apart cannot reach the similarity."""
    return F.least("w_a", "w_b") >= F.greatest("w_a", "w_b") * F.lit(least - 1e-9)


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_block(rows: dict[str, list], band_key: int, least: float, crossing: bool) -> list[tuple]:
    """Links that join different components among the rows of one bucket.

    With ``crossing`` only between the two sides. A pair is looked at in the first bucket that
    it shares; pairs whose sketches agree too seldom (five standard errors below ``least``) are
    skipped, the others compared exactly, unless links found before connect them.
    """
    n = len(rows["node"])
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(n, COORDINATES)
    keys = np.frombuffer(b"".join(rows["keys"]), np.uint64).reshape(n, BANDS)
    weight, side = np.array(rows["weight"]), np.array(rows["side"])
    number: dict[bytes, int] = {}
    root = np.array([number.setdefault(r, len(number)) for r in rows["root"]])
    floor = COORDINATES * (least - 5 * math.sqrt(least * (1 - least) / COORDINATES))
    band = int(np.flatnonzero(keys[0] == np.uint64(band_key & (2**64 - 1)))[0])
    top = list(range(len(number)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        far = np.minimum(weight[rest], weight[i]) < np.maximum(weight[rest], weight[i]) * (least - 1e-9)
        rest = rest[(root[rest] != root[i]) & ~far]
        if crossing:
            rest = rest[side[rest] != side[i]]
        rest = rest[(sketch[rest] == sketch[i]).sum(axis=1) >= floor]
        rest = rest[(keys[rest] == keys[i]).argmax(axis=1) == band]
        for j in rest.tolist():
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y and similarity(rows["bag"][i], rows["bag"][j]) >= least:
                top[max(x, y)] = min(x, y)
                out.append((rows["node"][i], rows["node"][j]))
    return out


def _block_links(mixed: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Links within large buckets (key, node, weight, root, n, total_weight), piece by piece.

    A bucket is cut into pieces of bounded size; every two pieces meet in one group, so memory
    is bounded and no pair of rows is written.
    """
    pieces = F.ceil(F.greatest(F.col("n") / PIECE_ROWS, F.col("total_weight") / PIECE_WEIGHT)).cast("int")
    side = F.pmod(F.xxhash64("node", "key"), pieces).cast("int")
    placed = (
        mixed.withColumn("pieces", pieces)
        .withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            "key", "node", "weight", "root", "side",
            F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
        )
    )

    def linked(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        crossing = rows["low"][0] != rows["high"][0]
        found = linked_block(rows, rows["key"][0], least, crossing)
        return pa.table(
            {
                "a": pa.array([f[0] for f in found], pa.binary()),
                "b": pa.array([f[1] for f in found], pa.binary()),
            }
        )

    return (
        placed.join(bags, "node")
        .select("key", "low", "high", "side", "node", "weight", "root", "bag", "sketch", "keys")
        .groupBy("key", "low", "high")
        .applyInArrow(linked, "a binary, b binary")
    )


def near_links(docs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes that join all components of the similarity graph.

    First every member of a bucket meets the member with the smallest node, of all buckets only
    once; then, in buckets that still hold several components, every member meets that leader;
    last, in buckets that even then hold several components, all pairs of members of different
    components are compared, pair by pair in small buckets and in pieces in large ones. So each
    pair that shares a bucket is linked, tested, or already connected.
    """
    rows = signed.select("node", "weight", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
    shared = shared.where("lead <> last").select("key", "lead")
    members = materialize(rows.join(shared, "key").distinct(), "bucket-members")
    nodes = (
        signed.join(members.select("node").distinct(), "node", "left_semi")
        .groupBy("node", "doc_id")
        .agg(F.count("*").alias("n"))
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "n")).alias("first"))
        .select("node", "first.doc_id", F.col("first.n").alias("n_rows"))
    )
    bags = packed_documents(docs, nodes)
    sizes = members.select(F.col("node").alias("lead"), F.col("weight").alias("w_b")).distinct()
    stars = (
        members.where("node <> lead")
        .select(F.col("node").alias("a"), F.col("weight").alias("w_a"), "lead")
        .distinct()
        .join(sizes, "lead")
        .withColumnRenamed("lead", "b")
        .where(_near_size(least))
    )
    tested = materialize(
        _pairs(stars.groupBy("a").agg(F.min("b").alias("b"))), "pairs"
    )
    links = materialize(compared(tested, bags, least), "links")
    roots = components(links)

    def split(df: DataFrame) -> DataFrame:
        """Pairs of ``df`` that lie in different components and were not tested."""
        a, b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
        apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
        return df.join(a, "a", "left").join(b, "b", "left").where(apart).select("a", "b")

    more = _pairs(split(stars.select("a", "b"))).join(tested, ["a", "b"], "left_anti")
    more = materialize(more, "pairs")
    if not more.isEmpty():
        links = materialize(links.union(compared(more, bags, least)), "links")
        tested, roots = tested.union(more), components(links)
    named = members.join(roots, "node", "left").select(
        "key", "node", "weight", F.coalesce("root", "node").alias("root")
    )
    per_bucket = (
        named.groupBy("key")
        .agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.count("*").alias("n"),
            F.sum("weight").alias("total_weight"),
        )
        .where("low <> high")
        .drop("low", "high")
    )
    mixed = materialize(named.join(per_bucket, "key"), "mixed-buckets")
    small = mixed.where(F.col("n") <= SMALL_BUCKET)
    one, two = (
        small.select(
            "key",
            F.col("node").alias(x),
            F.col("root").alias(f"root_{x}"),
            F.col("weight").alias(f"w_{x}"),
        )
        for x in "ab"
    )
    cross = one.join(two, "key").where(
        (F.col("root_a") != F.col("root_b")) & (F.col("a") < F.col("b")) & _near_size(least)
    )
    rest = materialize(_pairs(cross).join(tested, ["a", "b"], "left_anti"), "pairs")
    blocks = _block_links(mixed.where(F.col("n") > SMALL_BUCKET), bags, least)
    return links.union(compared(rest, bags, least)).union(blocks)


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, node, class_id, kept.

    Documents are linked from a weighted Jaccard similarity of five-word shingles of ``least``
    on; a class is a connected component and ``class_id`` its smallest doc_id. ``kept`` marks
    the row with that id, and of several texts with that id the one with the smallest node; only
    rows that repeat both are all marked. Texts of one to four words have one shingle of all of
    them; texts without words, and null texts, are classes by equal text only. Case of A-Z is
    folded. Null ids are a class id only where the class has no other. Other columns are left
    out; an empty table gives an empty result.
    """
    signed = materialize(signed_documents(docs), "signed")
    roots = components(near_links(docs, signed, least))
    named = (
        signed.select("doc_id", "node")
        .join(roots, "node", "left")
        .select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    classes = named.groupBy("root").agg(F.min(order).alias("first"))
    return named.join(classes, "root").select(
        "doc_id",
        "node",
        F.col("first.doc_id").alias("class_id"),
        (
            F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
        ).alias("kept"),
    )


def one_of_each(docs: DataFrame, least: float = 0.8, columns: tuple[str, ...] = ()) -> DataFrame:
    """The ``columns`` of the kept rows of ``docs``; of rows that repeat id and text, one."""
    kept = (
        near_duplicates(docs, least)
        .where("kept")
        .groupBy(F.col("doc_id").alias("_id"), F.col("node").alias("_kept"))
        .agg(F.count("*").alias("_rows"))
    )
    rows = docs.select(*columns, node_of(F.col("text")).alias("_node"))
    same = (F.col("_node") == F.col("_kept")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    found = rows.join(kept, same)
    once = found.where("_rows = 1").select(*columns)
    return once.union(
        found.where("_rows > 1").dropDuplicates(["_node", "_id"]).select(*columns)
    )
