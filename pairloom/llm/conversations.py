"""Prefix trie of conversations by collapsing whole sequences.

Every prefix of a conversation has a name of 128 bits: the exclusive or of one hash a turn, made
of the turn's depth and the digest of its role and text. So names are running values, the turns of
a conversation of any length stay spread over tasks, and no text moves.

Identical conversations collapse to one weighted sequence (its smallest conv_id stands for it) with
the list of their ids. Only the sequences' prefixes are aggregated, by weight. Leaves are the
sequences that no prefix of a longer one equals (anti-join).

Sums over a subtree need no tree: ``sum of n_convs * length`` is a sum over the sequences below,
each with what it has left from the node on; ``sum of length`` counts a node once, namely in the
sequence with the smallest id through it. That sequence owns the node, and a sequence owns a tail
of itself, so one depth a sequence says what it owns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.ordering import numbered, sized
from pairloom.operators.ranking import running
from pairloom.operators.skew import salted_join
from pairloom.session import materialize

MOST_SHARED = 5  # turns that a rebuilt conversation may take over
GROUP = 100
IDS_A_PIECE = 8192
NAME = ["depth", "h1", "h2"]


def _hashes(depth: Column, turn: Column) -> list[Column]:
    depth = depth.cast("long")
    return [F.xxhash64(depth, turn), F.xxhash64(turn, depth, F.lit("second"))]


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (from 1), n (turns of the conversation), turn_id, n_chars, chunk; stored."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat(sized(role), text))).alias("turn_id"),
        F.length(text).cast("long").alias("n_chars"),
    )
    placed = numbered(materialize(rows, "turns"), ["conv_id"], ["turn", "turn_id"])
    return materialize(
        placed.select("conv_id", (F.col("pos") + 1).alias("p"), "n", "turn_id", "n_chars", "chunk"),
        "ordered-turns",
    )


def _heads(turns: DataFrame) -> DataFrame:
    """conv_id, n, h and ``lead``: the prefixes made of turns that a conversation takes over."""
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("p") <= MOST_SHARED))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("p", "turn_id", "n_chars"))).alias("head")
    )
    convs = turns.where("p = 1").select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
        "n",
        shared_turns(F.col("conv_id")).alias("h"),
    )
    taken = convs.join(heads, "base", "left").select(
        "conv_id", "n", "h",
        F.slice(F.coalesce("head", F.array().cast("array<struct<p:long,turn_id:binary,n_chars:long>>")),
                F.lit(1), F.col("h")).alias("head"),
    )

    def name(upto: Column, which: int) -> Column:
        return F.aggregate(
            F.slice(F.col("head"), F.lit(1), upto),
            F.lit(0).cast("long"),
            lambda before, t: before.bitwiseXOR(_hashes(t["p"], t["turn_id"])[which]),
        )

    def chars(upto: Column) -> Column:
        return F.aggregate(
            F.slice(F.col("head"), F.lit(1), upto), F.lit(0).cast("long"), lambda a, t: a + t["n_chars"]
        )

    lead = F.transform(
        "head",
        lambda t, i: F.struct(
            t["p"].alias("depth"),
            name(i + 1, 0).alias("h1"), name(i + 1, 1).alias("h2"),
            name(i, 0).alias("p1"), name(i, 1).alias("p2"),
            t["n_chars"].alias("n_chars"), chars(i + 1).alias("so_far"),
        ),
    )
    return taken.select("conv_id", "n", "h", lead.alias("lead"))


def rebuilt_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All prefixes of at least one turn, and the whole of every rebuilt conversation.

    Prefixes: conv_id, depth, h1, h2, p1, p2 (the name one turn shorter), n_chars (of the last
    turn), so_far (of all turns). Whole: conv_id, depth, h1, h2, so_far; also turnless ones.
    """
    convs = materialize(_heads(turns), "conversation-heads")
    last = F.try_element_at("lead", F.lit(-1))
    none = F.lit(0).cast("long")
    before = {
        "b1": F.coalesce(last["h1"], none), "b2": F.coalesce(last["h2"], none),
        "so_far": F.coalesce(last["so_far"], none), "n_lead": F.size("lead").cast("long"),
    }
    starts = convs.select("conv_id", "h", *[c.alias(f"l_{k}") for k, c in before.items()])
    own = turns.where(F.col("p") > shared_turns(F.col("conv_id")))
    own = salted_join(own, starts, ["conv_id"], ["p"], None)
    own = own.withColumn("depth", F.col("l_n_lead") + F.col("p") - F.col("h"))
    v1, v2 = _hashes(F.col("depth"), F.col("turn_id"))
    own = materialize(own.withColumns({"v1": v1, "v2": v2}).drop("turn_id", "h", "l_n_lead"), "own-turns")
    along = running(
        own, ["conv_id"], ["p"],
        {"r1": ("xor", F.col("v1")), "r2": ("xor", F.col("v2")), "r": ("sum", F.col("n_chars"))},
    )
    h1, h2 = (F.col(f"l_b{i}").bitwiseXOR(F.col(f"r{i}")) for i in (1, 2))
    own = materialize(
        along.select(
            "conv_id", "depth", h1.alias("h1"), h2.alias("h2"),
            h1.bitwiseXOR(F.col("v1")).alias("p1"), h2.bitwiseXOR(F.col("v2")).alias("p2"),
            "n_chars", (F.col("l_so_far") + F.col("r")).alias("so_far"),
            (F.col("p") == F.col("n")).alias("is_last"),
        ),
        "own-prefixes",
    )
    prefixes = own.drop("is_last").unionByName(convs.select("conv_id", F.inline("lead")))
    no_own = convs.where("n <= h").select(
        "conv_id", before["n_lead"].alias("depth"), before["b1"].alias("h1"), before["b2"].alias("h2"),
        before["so_far"].alias("so_far"),
    )
    whole = own.where("is_last").select("conv_id", *NAME, "so_far").unionByName(no_own)
    return prefixes, whole


def ends_digest(whole: DataFrame) -> DataFrame:
    """depth, h1, h2, ends_sha256: hash of the comma-joined conv_ids that end there, ascending.

    Such a hash has to read the ids in order, so the ids are first sorted by range and written in
    pieces of text, and a group's pieces then stream through one hash: a task holds one piece,
    however many conversations are identical.
    """
    parts = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*NAME, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            names = list(zip(*[rows[c] for c in NAME], strict=True))
            first = 0
            cut: list[tuple] = []
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[first] or i - first == IDS_A_PIECE:
                    ids = rows["conv_id"][first:i]
                    cut.append((*names[first], ids[0], ",".join(map(str, ids))))
                    first = i
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*cut, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)]
                if cut else [pa.array([], pa.int64())] * 4 + [pa.array([], pa.string())],
                [*by, "ids"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, done = None, hashlib.sha256(), []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 4
            types = [pa.int64()] * 3 + [pa.string()]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(made, [*NAME, "ends_sha256"])

        for batch in batches:
            rows = batch.to_pydict()
            for *own, ids in zip(*[rows[c] for c in (*NAME, "ids")], strict=True):
                if own == name:
                    state.update(b",")
                else:
                    if name is not None:
                        done.append((*name, state.hexdigest()))
                    name, state = own, hashlib.sha256()
                state.update(ids.encode())
            yield flush()
        if name is not None:
            done.append((*name, state.hexdigest()))
        yield flush()

    sorted_ids = whole.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    texts = sorted_ids.mapInArrow(pieces, "depth long, h1 long, h2 long, conv_id long, ids string")
    dealt = texts.repartition(parts, *NAME).sortWithinPartitions(*by)
    return dealt.mapInArrow(hashed, "depth long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (conv_id, turn, role, text).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns are ordered by ``turn``, null first, equal ones by the digest
    of role and text; null role or text is empty. A conversation is rebuilt from the first h turns
    of the first of its hundred and its own turns after its first h, h from the hash of its id.
    Rows without a conv_id belong to no conversation; repeated rows are turns of their own; other
    columns are left out; an empty table has no node.
    """
    turns = ordered_turns(conversations)
    prefixes, whole = rebuilt_prefixes(turns)
    whole = materialize(whole, "whole")
    sequences = materialize(
        whole.groupBy(*NAME).agg(
            F.min("conv_id").alias("seq"), F.count("*").alias("weight"), F.first("so_far").alias("chars")
        ),
        "sequences",
    )
    ends = ends_digest(whole)
    chosen = salted_join(
        prefixes, sequences.select(F.col("seq").alias("conv_id"), "weight", "chars"), ["conv_id"], ["depth"], None
    ).select(
        F.col("conv_id").alias("seq"), *NAME, "p1", "p2", "n_chars",
        (F.col("so_far") - F.col("n_chars")).alias("before"), "weight", "chars",
    )
    zero = F.lit(0).cast("long")
    root = sequences.select(
        "seq", *[zero.alias(c) for c in (*NAME, "p1", "p2", "n_chars", "before")], "weight", "chars"
    )
    rows = materialize(chosen.unionByName(root), "weighted-prefixes")
    nodes = materialize(
        rows.groupBy(*NAME).agg(
            F.min("seq").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("before").alias("before"),
            F.sum(F.col("weight") * (F.col("chars") - F.col("before"))).alias("gross"),
        ),
        "nodes",
    )
    owned = nodes.groupBy(F.col("conv_id").alias("seq")).agg(
        F.min(F.struct("depth", "before")).alias("own")
    )
    inner = materialize(
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
        .agg(F.count("*").alias("n_children")),
        "inner-nodes",
    )
    leaves = sequences.join(inner, NAME, "left_anti").select("seq", F.lit(1).alias("leaf"))
    said = sequences.select("seq").join(owned, "seq", "left").join(leaves, "seq", "left")
    once = F.col("chars") - F.when(F.col("depth") >= F.col("own.depth"), F.col("before")).otherwise(
        F.col("own.before")
    )
    sums = (
        salted_join(rows.select("seq", *NAME, "before", "chars"), said, ["seq"], ["depth"], None)
        .groupBy(*NAME)
        .agg(
            F.count("leaf").alias("n_leaves"),
            F.coalesce(F.sum(F.when(F.col("own").isNotNull(), once)), zero).alias("distinct_chars"),
        )
    )
    parents = nodes.select(
        F.col("depth").alias("p0"), F.col("h1").alias("p1"), F.col("h2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    named = salted_join(
        nodes.withColumn("p0", F.col("depth") - 1), parents, ["p0", "p1", "p2"], ["h1"], None, how="left"
    )
    full = named.join(sums, NAME).join(inner, NAME, "left").join(ends, NAME, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        (F.col("gross") - F.col("distinct_chars")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
