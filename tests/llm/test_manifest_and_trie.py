"""Merkle manifest and conversation trie against plain Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import merkle
from pairloom.llm.conversations import prefix_trie
from pairloom.llm.registry import LLM_QUERIES

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return sha("".join(field(row[f]) for f in FIELDS))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return out


def siblings(tree, pos):
    out = []
    for level in tree[:-1]:
        first = pos // 8 * 8
        out.append(("".join(level[first:pos]), "".join(level[pos + 1 : first + 8])))
        pos //= 8
    return out


def brute_manifest(rows):
    trees = collections.defaultdict(list)
    for row in rows:
        trees[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: r[:3])
    built = {n: levels([r[2] for r in trees[n]]) for n in names}
    top = levels([built[n][-1][0] for n in names])
    out = []
    for i, name in enumerate(names):
        for pos, (_, _, own, row) in enumerate(trees[name]):
            path = siblings(built[name], pos) + siblings(top, i)
            acc = own
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                acc = leaf({**row, "text": row["text"] and row["text"].translate(FOLD)})
            for left, right in path:
                acc = sha(left + acc + right)
            root = top[-1][0]
            proof = sha("".join(a + b for a, b in path))
            out.append((row["doc_id"], own, built[name][-1][0], root, proof, acc, acc == root))
    return sorted(out, key=str)


def documents(seed, n, langs):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        text = pick.choice(["Some Text", "lower only", "", None, "É ÀB z", "x" * 3000])
        rows.append((pick.randrange(n), text, pick.choice(langs), pick.choice(["s", None]), pick.choice([1, None])))
    rows += rows[:3]
    if n > 5:
        rows += [(None, "A", langs[0], "s", 1), (None, None, None, None, None), (None, "A", langs[0], "s", 1)]
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        documents(1, 1200, ["en", "en", "en", "en", "en", "de", "é", None]),
        documents(2, 9, ["en"]),
        documents(3, 1, [None]),
        [(7, "One", "en", None, 3)],
        [(i, "T", f"l{i}", None, 1) for i in range(70)],
        [],
    ],
    ids=["several blocks", "few", "null language", "one", "many languages", "none"],
)
def test_manifest_equals_brute_force(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, DOCUMENT)
    for name in ("node", "pos", "tree", "path", "leaf", "root", "top", "n", "chunk", "l0"):
        frame = frame.withColumn(name, F.lit("clash"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = LLM_QUERIES["op12_merkle"](spark, str(tmp_path)).collect()
    want = brute_manifest([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])
    assert sorted(map(tuple, got), key=str) == want


def test_manifest_shows_where_rows_changed(spark):
    rows = [(i, f"Text {i}", "en", "s", 1) for i in range(40)]
    frame = spark.createDataFrame(rows, DOCUMENT)
    made = merkle.manifest(frame, FIELDS, "doc_id", "lang")
    now = frame.withColumn("text", F.when(F.col("doc_id") == 17, "other").otherwise(F.col("text")))
    again = now.select("doc_id", merkle.leaf_digest([F.col(f) for f in FIELDS]).alias("now"))
    checked = merkle.verified(made.join(again, "doc_id"), "now")
    assert [r.doc_id for r in checked.where("NOT verified").collect()] == [17]


def brute_trie(rows):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            talks[conv].append((turn is not None, turn or 0, tie, role, text))
    talks = {c: [t[3:] for t in sorted(ts)] for c, ts in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = talks.get(c - c % 100, [])[:h] + own[h:]
    members = collections.defaultdict(set)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    out = []
    for node, of in members.items():
        below = [m for m in members if m[: len(node)] == node]
        inner = {m[:-1] for m in below if m}
        kids = sum(1 for m in below if len(m) == len(node) + 1)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in of if len(rebuilt[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(1 for m in below if m not in inner)
        out.append((min(of), len(node), parent, len(of), kids, leaves, saved, sha(ends)))
    return sorted(out, key=str)


def talks(seed, n):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = pick.choice([0, 100, 200, 300, 301, 302, *range(0, 30), 205, 299, 777, 901])
        for turn in range(pick.randint(1, 7)):
            text = pick.choice(["hi", "é𝄞x", "", None, "long " * 20, "a", "b"])
            rows.append((conv, pick.choice([turn, turn, turn, None]), pick.choice(["user", "assistant", None]), text))
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        talks(1, 60),
        [(c, t, "u", "ab"[t % 2]) for c in range(40) for t in range(4)],
        [(c, t, "u", "same") for c in (5, 105, 205) for t in range(40)] + [(None, 1, "u", "x")],
        [(5, None, None, None)] * 30 + [(6, 1, "u", "x")],
        [],
    ],
    ids=["random", "copies", "long", "equal rows", "none"],
)
def test_trie_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr("pairloom.llm.conversations.IDS_A_PIECE", 3)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("h1", "depth", "p", "pos", "n", "chunk", "seq", "lead"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = sorted(map(tuple, prefix_trie(frame).collect()), key=str)
    assert got == brute_trie(rows)
