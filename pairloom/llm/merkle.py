"""Merkle manifest of a dataset by concatenated-level strings.

The leaves of a tree stand in order and are cut into aligned blocks of 512. A block keeps each of
its levels as one string of hex digests, so a parent is the hash of a substring of fixed width,
and the siblings of a node are the substrings beside it within its run of eight. The tops of all
blocks are the leaves of the same procedure one storey higher, until one node remains; the
remaining nodes of all trees are the leaves of the last tree. Nothing but a digest and the key of
a row moves; texts stay where they are read.

A path is the list of (left, right) sibling strings of a node from its own level to the root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.ordering import numbered, sized
from pairloom.session import materialize

ARITY = 8
STOREY = 3  # levels that one block holds
BLOCK = ARITY**STOREY
HEX = 64
_RUN = ARITY * HEX
_PATH = "array<struct<left: binary, right: binary>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values: list[Column]) -> Column:
    return digest(*[sized(v) for v in values])


def _parents(level: Column) -> Column:
    """The next level of a block: each run of eight digests by its hash."""
    runs = F.ceil(F.octet_length(level) / F.lit(_RUN)).cast("int")
    hashes = F.transform(
        F.sequence(F.lit(0), runs - 1),
        lambda i: F.sha2(F.substring(level, i * _RUN + 1, F.lit(_RUN)), 256),
    )
    return F.array_join(hashes, "").cast("binary")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """tree, block, n, rows in order, and the levels l0 to l3 (null above the last node)."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "node", *carry)))
    out = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.max("n").alias("n"), rows.alias("rows")
    )
    out = out.withColumn("l0", F.array_join(F.col("rows.node"), "").cast("binary"))
    for k in range(STOREY):
        below = F.col(f"l{k}")
        several = (F.col("n") > BLOCK) | (F.octet_length(below) > HEX)
        out = out.withColumn(f"l{k + 1}", F.when(several, _parents(below)))
    return out


def _steps() -> Column:
    """The sibling strings of the node at ``i`` of a block, level by level."""
    steps = []
    for k in range(STOREY):
        at = F.floor(F.col("i") / ARITY**k).cast("int")
        first = (F.floor(at / ARITY) * ARITY).cast("int")
        level = F.col(f"l{k}")
        left = F.substring(level, first * HEX + 1, (at - first) * HEX)
        right = F.substring(level, (at + 1) * HEX + 1, (first + (ARITY - 1) - at) * HEX)
        step = F.struct(left.alias("left"), right.alias("right"))
        steps.append(F.when(F.col(f"l{k + 1}").isNotNull(), step))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def climb(
    nodes: DataFrame,
    carry: tuple[str, ...] = (),
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """tree, pos, node, the columns ``carry``, top and path for nodes (tree, pos, n, node).

    ``pos`` counts from 0 within a tree and ``n`` is the tree's number of nodes. ``finish`` may
    add columns to the table of block tops (tree, pos, top, path), and lengthen paths there.
    """
    blocks = materialize(_blocks(nodes, list(carry)), "levels")
    tops = blocks.select(
        "tree",
        F.col("block").alias("pos"),
        F.ceil(F.col("n") / BLOCK).alias("n"),
        F.coalesce(*[F.col(f"l{k}") for k in range(STOREY, -1, -1)]).cast("string").alias("node"),
    )
    if tops.where("n > 1").isEmpty():
        above = tops.select("tree", "pos", F.col("node").alias("top"), F.array().cast(_PATH).alias("path"))
    else:
        above = climb(tops).drop("node")
    if finish:
        above = finish(above)
    extra = [c for c in above.columns if c not in ("tree", "pos", "path")]
    found = blocks.join(
        above.withColumnRenamed("pos", "block").withColumnRenamed("path", "_above"), ["tree", "block"]
    )
    levels = [f"l{k}" for k in range(STOREY + 1)]
    spread = found.select("tree", *extra, "_above", *levels, F.posexplode("rows").alias("i", "r"))
    return spread.select(
        "tree",
        "r.pos",
        "r.node",
        *[F.col(f"r.{c}").alias(c) for c in carry],
        *extra,
        F.concat(_steps(), F.col("_above")).alias("path"),
    )


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the siblings of its path give."""
    return F.aggregate(
        path,
        node.cast("binary"),
        lambda below, s: digest(s["left"], below, s["right"]).cast("binary"),
    ).cast("string")


def proof_digest(path: Column) -> Column:
    """Hash of all sibling digests of a path, level by level, left to right."""
    return F.sha2(
        F.aggregate(
            path, F.lit("").cast("binary"), lambda before, s: F.concat(before, s["left"], s["right"])
        ),
        256,
    )


def _tree_key(name: Column) -> Column:
    """Null before all, else the bytes of the name."""
    return F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("x"), name.cast("string")))


def manifest(
    rows: DataFrame,
    fields: list[str],
    key: str,
    tree: str,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: key, the columns ``also``, leaf, subroot, root, path.

    A leaf is the digest of ``fields``, null as ``-``, others as UTF-8 byte count, ``:`` and
    value. Within a value of ``tree`` leaves ascend by ``key`` (null first; equal keys by leaf);
    while several nodes remain, every eight in a row (fewer at the end, even one) become their
    hash. What remains is the subroot; subroots in order of ``tree`` (null first, by bytes) give
    the root in the same way. Repeated rows keep their places, an empty table gives no rows, and
    columns of the input that are not named are left out. ``also`` is computed from the input.
    """
    also = also or {}
    leaves = materialize(
        rows.select(
            _tree_key(F.col(tree)).alias("tree"),
            F.col(key).alias("_key"),
            leaf_digest([F.col(f) for f in fields]).alias("node"),
            *[c.alias(f"_{name}") for name, c in also.items()],
        ),
        "leaves",
    )

    def with_root(above: DataFrame) -> DataFrame:
        above = materialize(above, "subroots")
        subroots = above.where("pos = 0").select(
            F.lit("").alias("tree"), F.col("tree").alias("_name"), F.col("top").alias("node")
        )
        last = climb(numbered(subroots, ["tree"], ["_name"]), ("_name",)).select(
            F.col("_name").alias("tree"), F.col("top").alias("root"), F.col("path").alias("_last")
        )
        return above.join(last, "tree").select(
            "tree", "pos", "top", "root", F.concat("path", "_last").alias("path")
        )

    placed = numbered(leaves, ["tree"], ["_key", "node"])
    out = climb(placed, ("_key", *[f"_{name}" for name in also]), with_root)
    return out.select(
        F.col("_key").alias(key),
        *[F.col(f"_{name}").alias(name) for name in also],
        F.col("node").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        "path",
    )


def verified(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Add proof_sha256, folded_root (from the column ``leaf`` and the path) and verified."""
    folded = rows.withColumn("folded_root", fold(F.col(leaf), F.col("path")))
    return folded.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def tampered_leaf(fields: list[str], text: str, key: str, every: int) -> Column:
    """The leaf of a row whose text was set to lower case (A-Z), null for rows left as they are.

    Touched are rows whose unsigned crc32 of the key as text is divisible by ``every``; a null
    text stays null.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = [F.translate(f, upper, upper.lower()) if f == text else F.col(f) for f in fields]
    chosen = F.crc32(F.col(key).cast("string").cast("binary")) % every == 0
    return F.when(chosen, leaf_digest(changed))
