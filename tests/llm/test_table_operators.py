"""Mixing, quality, archives, vectors, components and the pipeline on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from pairloom.llm import mixing, quality, vector_join
from pairloom.llm.components import components
from pairloom.llm.mixing import mixed_spans, plan_mix, source_targets, taken_words
from pairloom.llm.quality import score_documents, train_classifier
from pairloom.llm.registry import LLM_ORACLE, LLM_QUERIES
from pairloom.llm.vector_join import spanning_edges, vector_links
from pairloom.llm.warc import fetch_records, frame_places, read_bundles, write_bundles
from pairloom.session import materialize

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def _water_fill(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in order}
        above = {s for s in order if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_resharing(spark, seed):
    pick = random.Random(seed)
    sizes = {f"s{i}": pick.choice([0, 1, 5, 50, 900]) for i in range(9)} | {None: 40, "Z": 3}
    rows = [(s, n) for s, n in sizes.items()]
    got = source_targets(spark.createDataFrame(rows, "source string, size long"), (1, 2, 3), 3.0)
    want = _water_fill(sizes, (1, 2, 3), 3)
    assert {r.source: r.target for r in got.collect()} == pytest.approx(want)


def test_mix_takes_its_targets_and_repeats(spark):
    pick = random.Random(1)
    rows = [
        (i, " ".join("w" * pick.randint(0, 200)), None, pick.choice(["a", "a", "a", "b", "é", None]), 1)
        for i in range(300)
    ] + [(None, None, None, "a", 0), (None, "x y", None, "b", 0), (5, "x y", None, "b", 0), (5, "x y", None, "b", 0)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    mix = plan_mix(docs, block_words=16)
    got = taken_words(mix).collect()
    assert len(got) == len(rows)
    by_source = collections.defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for group in by_source.values():
        assert sum(r["size"] for r in group) == group[0].source_size
        assert abs(sum(r.taken for r in group) - group[0].target) <= 1
    again = taken_words(plan_mix(docs.repartition(7, "source"), block_words=16)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    slots = [r for r in mixed_spans(mix).collect() if r.slot is not None]
    assert all(0 <= r.from_word <= r.to_word <= r["size"] for r in slots)
    early = [r for r in slots if r.slot < 300]
    share = collections.Counter()
    for r in early:
        share[r.source_rank] += r.to_word - r.from_word
    total = sum(r.target for r in mix.sources.collect())
    for r in mix.sources.collect():
        assert abs(share[r.source_rank] / sum(share.values()) - r.target / total) < 0.03


def test_words_taken_of_each_document_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_A_PIECE", 16)
    monkeypatch.setattr(mixing, "COPIES_A_ROW", 7)
    pick, block = random.Random(2), 16
    rows = [(i, pick.randint(0, 90), pick.choice(["a", "a", "b", None])) for i in range(120)]
    # A hot id, a hot null id, and one row many times over.
    rows += [(7, pick.randint(0, 5), "a") for _ in range(60)]
    rows += [(None, pick.randint(0, 5), "b") for _ in range(60)]
    rows += [(500, 11, "b")] * 30
    docs = spark.createDataFrame([(i, "w " * n, None, s, 0) for i, n, s in rows], DOCUMENT)
    mix = taken_words(plan_mix(docs, block_words=block)).collect()
    got = sorted(str((r.doc_id, r.source, r["size"], r.taken)) for r in mix)
    ids = docs.select("doc_id").distinct().select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.lit(-(-len(rows) // 16))).alias("bucket"),
        F.xxhash64("doc_id", F.lit("order")).alias("key"),
    )
    order = {r.doc_id: (r.bucket, r.key) for r in ids.collect()}
    sources, total = ["a", "b", None], sum(n for _, n, _ in rows)
    size = [sum(n for _, n, s in rows if s == source) for source in sources]
    stopped: dict[int, float] = {}
    while True:
        rest = [i for i in range(3) if i not in stopped]
        level = (total - sum(stopped.values())) / sum(i + 1 for i in rest)
        over = {i: 3.0 * size[i] for i in rest if level * (i + 1) > 3 * size[i]}
        if not over:
            break
        stopped |= over
    quota = [math.floor(stopped.get(i, level * (i + 1)) + 0.5) for i in range(3)]
    blocks = [-(-n // block) for n in size]
    slots = [q // n * b + -(-(q % n) // block) for q, n, b in zip(quota, size, blocks, strict=True)]
    turns, upto = [0, 0, 0], [sum(slots[: i + 1]) for i in range(3)]
    for slot in range(sum(slots)):
        point = slot * mixing.GOLDEN % mixing.POINTS
        turns[next(i for i in range(3) if point < math.floor(upto[i] / sum(slots) * mixing.POINTS))] += 1
    want = []
    for i, source in enumerate(sources):
        # Idle slots and those at the end make the turns of each source 0 .. slots - 1.
        assert abs(turns[i] - slots[i]) < 8
        taken = collections.Counter()
        for turn in range(slots[i]):
            begin = turn % blocks[i] * block
            words = min(block, quota[i] - turn // blocks[i] * size[i] - begin)
            taken.update(w for w in range(begin, begin + words) if w < size[i])
        place = 0
        for doc, n, _ in sorted((r for r in rows if r[2] == source), key=lambda r: (*order[r[0]], r[1])):
            want.append(str((doc, source, n, sum(taken[w] for w in range(place, place + n)))))
            place += n
    assert got == sorted(want)


def test_spanning_edges_connect_what_links_connect():
    pick = np.random.default_rng(3)

    def classes(n, edges):
        top = list(range(n))
        for _ in range(n):
            for x, y in edges:
                top[x] = top[y] = min(top[x], top[y])
        return top

    for share in (0.0, 0.02, 0.1, 1.0):
        links = pick.random((30, 20)) < share
        edges = spanning_edges(links, False)
        assert len(edges) <= 49 and all(links[e] for e in edges)
        joined = classes(50, [(i, j + 30) for i, j in edges])
        assert joined == classes(50, [(i, j + 30) for i, j in zip(*np.nonzero(links), strict=True)])
        links = pick.random((30, 30)) < share
        links = links | links.T
        np.fill_diagonal(links, False)
        edges = spanning_edges(links, True)
        assert len(edges) <= 29 and all(links[e] for e in edges)
        assert classes(30, edges) == classes(30, list(zip(*np.nonzero(links), strict=True)))


def test_non_negative_risk_learns_from_positives():
    random_ = np.random.default_rng(0)
    good = random_.normal(0, 1, (600, 5))
    mixed = np.vstack([random_.normal(0, 1, (700, 5)), random_.normal(3, 1, (300, 5))])
    model = quality.fit(good, mixed)
    assert 0.5 < model.prior < 0.9
    assert (model.logits(random_.normal(0, 1, (200, 5))) > -0.85).mean() > 0.95
    assert (model.logits(random_.normal(3, 1, (200, 5))) < -0.85).mean() > 0.95


def test_sample_is_bounded_in_rows(spark):
    rows = [(1, f"text {i} of one id") for i in range(300)] + [(i, f"other {i}") for i in range(2, 12)]
    docs = spark.createDataFrame([*rows, (12, None)], "doc_id long, text string")
    ids = docs.select("doc_id")
    assert len(quality._sample(docs, ids, 50)) == 12
    assert len(quality._sample(docs, ids, 5)) == 5
    again = docs.orderBy(F.desc("text")).repartition(3)
    assert (quality._sample(docs, ids, 50) == quality._sample(again, ids, 50)).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in LLM_QUERIES["op6_quality"](spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    held = [x for x in labels if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert all(got[x["doc_id"]].held_out for x in held)
    right = sum(got[x["doc_id"]].predicted == x["quality"] for x in held)
    assert right / len(held) >= 0.95
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())


def test_scores_without_labels_and_of_odd_texts(spark):
    rows = [(1, "a b", "x", "s", 3), (None, None, None, None, None), (1, "", "x", "s", 0)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = train_classifier(docs, labels)
    assert model is None
    got = score_documents(docs, model, keep=("doc_id", "text", "lang")).collect()
    assert [r.score for r in got] == [0.5] * 3 and len(got[0]) == 5


def test_archives_round_trip(spark):
    long = "é" * 80
    rows = [(3, "http://a/b c\r\nX: y", long), (1, None, long), (2, "u", long), (4, "u", "short"), (5, "u", "short")]
    rows += [(6, "u", None), (None, "u", long), (None, "v", "q" * 150), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    rows += [(100 + i, f"u{i}", f"page {i} " * 300) for i in range(400)]
    bundles = write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = read_bundles(bundles).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    for page, _, html in rows:
        if page is not None:
            body = (html or "").encode()
            r = by_id[page]
            assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
            assert r.record_type == ("revisit" if page in (2, 3) else "response")
            assert r.refers_to == (1 if page in (2, 3) else None)
            assert r.payload is None if page in (2, 3) else bytes(r.payload) == body
    nulls = sorted((r.record_type, r.refers_to) for r in got if r.page_id is None)
    assert nulls == [("response", None), ("revisit", 1)]
    wanted = spark.createDataFrame([(7,), (250,), (3,), (9999,)], "page_id long")
    assert sorted(r.page_id for r in fetch_records(bundles, wanted).collect()) == [3, 7, 250]
    archive = bytes(bundles.first().archive)
    assert sum(p for _, p, _ in frame_places(archive)) < len(archive)


def test_archives_equal_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = duck.execute(LLM_ORACLE["op7_warc"])
    columns = [c[0] for c in want.description]
    got = LLM_QUERIES["op7_warc"](spark, sf_dir).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def _links(rows, least):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n, top = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b) or a @ b < least:
                continue
            links[i] += 1
            links[j] += 1
            top[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return sorted(
        (str(r[0]), links[i], str(min(ids[find(i)], default=None))) for i, r in enumerate(rows)
    )


@pytest.mark.parametrize(("interval", "leaf"), [(512, 64), (5, 2)])
def test_vector_links_equal_brute_force(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(vector_join, "INTERVAL", interval)
    monkeypatch.setattr(vector_join, "LEAF", leaf)
    pick = np.random.default_rng(3)
    rows = []
    for i in range(150):
        base = pick.normal(0, 1, 12)
        for copy in range(1 + 3 * (i % 5 == 0)):
            near = base + pick.normal(0, 0.05, 12) * (copy > 1)
            rows.append((len(rows), near.astype(np.float32).tolist(), int(i % 3)))
    rows += [(900 + i, rows[0][1], 0) for i in range(5)] + [(990, [2 * x for x in rows[0][1]], 0)]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0, None] * 6, [1.0, 2.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(1100, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(1200, [1.0, 2.0], 0), (1201, [1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_links(frame).collect()
    shown = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got)
    assert shown == _links(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_components_of_chains_and_stars(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)]
    edges += [(300 + 2 * i, 301 + 2 * i) for i in range(20)] + [(5, 5), (70, 70)]
    shuffled = pick.sample(range(1000), 400)
    edges = [(shuffled[a], shuffled[b]) for a, b in edges]
    top = list(range(1000))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _write(spark, folder, name, rows, schema, clash=True):
    frame = spark.createDataFrame(rows, schema)
    if clash:
        for column in ("node", "chunk", "score", "size", "slot", "key", "label_", "_text", "kept", "spans", "mark"):
            frame = frame.withColumn(column, F.lit("clash"))
    frame.write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    text = " ".join(f"w{i % 50}" for i in range(90))
    odd = request.param == "odd"
    docs = [(1, text, "en", "a", 9), (2, None, None, None, None), (None, "", "en", "a", 0), (3, text, "en", "b", 9)]
    docs += [(3, text, "en", "b", 9), (4, "x " * 30_000, "en", "a", 1), (5, "y" * 50_000, None, "b", 1)]
    docs += [(6, "a@b.cd 1.2.3.4", "en", "c", 14)]
    _write(spark, path, "documents", docs if odd else [], DOCUMENT)
    labels = [(1, 1, 0), (3, None, None), (None, 1, 0), (4, 0, 0), (4, 1, 0)]
    _write(spark, path, "labels", labels if odd else [], "doc_id long, quality int, toxic int")
    items = [(1, None), (None, " ".join(f"w{i}" for i in range(20))), (2, "")]
    _write(spark, path, "benchmark", items if odd else [], "item_id long, text string")
    pages = [(1, None, None), (None, "u", "x" * 200), (1, "u", "x" * 200)]
    _write(spark, path, "pages", pages if odd else [], "page_id long, url string, html string")
    vectors = [(1, None, 1), (None, [1.0, 2.0], None), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]
    talks = [(1, None, None, None), (1, 0, "user", "x"), (None, 1, "user", "y"), (2, 0, "user", "x")]
    _write(spark, path, "conversations", talks if odd else [], "conv_id long, turn long, role string, text string")
    _write(spark, path, "embeddings", vectors if odd else [], "vec_id long, embedding array<float>, label int")
    return str(path), odd


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_empty_and_odd_tables(spark, folder, name):
    path, odd = folder
    got = LLM_QUERIES[name](spark, path).collect()
    full = {"op7_warc": 3, "op8_vector_join": 4, "op13_prefix_trie": 1}.get(name, 8) if odd else 0
    assert len(got) == full or name == "pipeline" and len(got) <= full


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = materialize(stage(spark, kept, sf_dir), "stage")
        assert kept.columns == docs.columns
        seen.append({r.doc_id: r.text for r in kept.collect()})
    scored = LLM_QUERIES["op6_quality"](spark, sf_dir).collect()
    assert set(seen[0]) == {r.doc_id for r in scored if r.predicted == 1}
    texts = list(seen[1].values())
    assert len(set(texts)) == len(texts)
    classes = {seen[0][d] for d in seen[0]} - set(texts)
    assert all(any(_similar(t, k) for k in texts) for t in classes)
    assert all(not any(i in t for i in items) for t in seen[2].values())
    gone = set(seen[1]) - set(seen[2])
    assert all(any(_windows(rows[d].text, i) >= 0.8 for i in items) for d in gone)
    assert set(seen[3]) == set(seen[2])
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    for d, text in seen[3].items():
        assert not re.search(email, text)
        assert text == seen[2][d] or "[" in text


def _runs(text):
    w = text.lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def _similar(a, b):
    x, y = _runs(a), _runs(b)
    weigh = lambda c: sum(1 + math.log(n) for n in c.values())
    shared = weigh(x & y)
    return shared / (weigh(x) + weigh(y) - shared) > 0.5


def _windows(text, item):
    w, n, own = text.lower().split(), len(item.split()), _runs(item)
    best = 0.0
    for p in range(max(1, len(w) - n + 1)):
        part = _runs(" ".join(w[p : p + n]))
        shared = (part & own).total()
        best = max(best, shared / (part.total() + own.total() - shared))
    return best
