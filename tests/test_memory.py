"""Translation memory against every pair, skewed joins, and the lexical table."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.operators import lexicon, memory, nearest, skew


def grams(text, n):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(train, queries, wanted=nearest.Wanted(0), upto=None):
    """Best source of every query: (score, rank, target) or None."""
    out = {}
    for pid, q in queries:
        a = grams(q, wanted.gram_order)
        best = None
        for rk, s, t in train:
            b = grams(s, wanted.gram_order)
            k = len(a & b)
            if not k or (upto and rk > upto):
                continue
            sim = wanted.score(k, len(a), len(b))
            if sim >= wanted.floor and (best is None or (sim, -rk) > (best[0], -best[1])):
                best = (sim, rk, t)
        out[pid] = best
    return out


def texts(seed, n, near):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < near:  # near copies with a rare head word
            out.append(f"id{seed}x{i} common words that all copies share")
        elif kind < near + 0.2:  # exact copies
            out.append("same text again and again")
        else:
            out.append(" ".join(rng.choices("abcdefghijkl", k=rng.randint(0, 9))))
    return out


def frames(spark, train, queries):
    return (
        spark.createDataFrame(train, "rk long, source string, target string"),
        spark.createDataFrame(queries, "pair_id string, source string"),
    )


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_SOURCES", 20)
    monkeypatch.setattr(nearest, "FEWEST_PAIRS", 50)


@pytest.mark.parametrize("floor", [0.0, 0.5, 1.0])
def test_equals_all_pairs(spark, small_blocks, floor):
    train = [(i + 1, s, f"target {i}") for i, s in enumerate(texts(1, 120, 0.3))]
    queries = [(f"q{i}", s) for i, s in enumerate(texts(2, 60, 0.3))]
    wanted = nearest.Wanted(0, floor=floor)
    expected = brute(train, queries, wanted)
    got = memory.tm_predict(*frames(spark, train, queries), wanted).collect()
    assert len(got) == len(queries)
    for r in got:
        best = expected[r["pair_id"]]
        if best is None:
            assert r["match_rk"] is None and r["prediction"] == ""
        else:
            assert (r["match_rk"], r["prediction"]) == (best[1], best[2])
            assert r["similarity"] == pytest.approx(best[0])


def test_every_query_that_shares_a_word_has_its_best(spark, small_blocks):
    train = [(i + 1, s, f"target {i}") for i, s in enumerate(texts(1, 120, 0.3))]
    queries = [(f"q{i}", s + f" r{i} s t u v w x y z") for i, s in enumerate(texts(2, 60, 0.3))]
    queries += [("none", "no such word"), ("empty", "")]
    expected = brute(train, queries)
    got = memory.tm_predict(*frames(spark, train, queries)).collect()
    assert len(got) == len(queries)
    open_ = sum(best is None for best in expected.values())
    assert min(best[0] for best in expected.values() if best) < 0.25
    for r in got:
        best = expected[r["pair_id"]]
        assert r["n_unmatched"] == open_
        assert (r["match_rk"], r["prediction"]) == ((best[1], best[2]) if best else (None, ""))
        assert r["similarity"] == (pytest.approx(best[0]) if best else None)


def test_all_scores_and_tiers_in_one_search(spark, small_blocks):
    train = [(i + 1, s, "") for i, s in enumerate(texts(3, 90, 0.2))]
    queries = [(f"q{i}", s) for i, s in enumerate(texts(4, 30, 0.2))]
    wanted = [nearest.Wanted(0), nearest.Wanted(1, 2, 0.5, 0.3), nearest.Wanted(2, 2, 2.0), nearest.Wanted(3, 3, 1.0, 0.7)]
    tiers = [7, 40, 80]
    best, sets = nearest.best_matches(*frames(spark, train, queries), wanted, tiers)
    rows = sets.join(best, ["gram_order", "query_key"]).collect()
    got = {(r["pair_id"], r["key"], r["tier"]): (r["rk"], r["score"]) for r in rows}
    assert len(got) == len(rows)
    want = {}
    for w in wanted:
        for tier, upto in enumerate(tiers):
            for pid, found in brute(train, queries, w, upto).items():
                if found:
                    want[pid, w.key, tier] = (found[1], pytest.approx(found[0]))
    assert got == want


def test_a_later_search_goes_on_from_a_former(spark, small_blocks):
    train = [(i + 1, s, "") for i, s in enumerate(texts(5, 90, 0.2))]
    queries = [(f"q{i}", s) for i, s in enumerate(texts(6, 30, 0.2))]
    sources, asked = frames(spark, train, queries)
    first, _ = nearest.best_matches(sources, asked, [nearest.Wanted(0)], [40])
    best, sets = nearest.best_matches(
        sources.where("rk > 40"), asked, [nearest.Wanted(0)], [60, 90], first.drop("tier")
    )
    got = {(r["pair_id"], r["tier"]): r["rk"] for r in sets.join(best, ["gram_order", "query_key"]).collect()}
    want = {
        (pid, tier): found[1]
        for tier, upto in enumerate((60, 90))
        for pid, found in brute(train, queries, upto=upto).items() if found
    }
    assert got == want


def test_bounds_spare_visits(spark, small_blocks, monkeypatch):
    """A query with a copy among the sources visits no block of other sizes."""
    train = [(i + 1, " ".join(f"w{j}" for j in range(i % 40, i % 40 + 1 + i // 4)), "") for i in range(160)]
    queries = [(f"q{i}", train[i][1]) for i in range(0, 160, 10)]
    visits = []
    visit = nearest._visit
    monkeypatch.setattr(nearest, "_visit", lambda v, *rest: visits.append(v.count()) or visit(v, *rest))
    best, _ = nearest.best_matches(*frames(spark, train, queries), [nearest.Wanted(0)])
    assert best.where("score = 1").count() == len(queries)
    assert visits[0] == len(queries) and visits[1] <= len(queries)


def test_near_copies_share_their_best(spark):
    """Sources that differ in a rare word only: the first of them answers all."""
    train = spark.range(300).select(
        (F.col("id") + 1).alias("rk"),
        F.concat(F.lit("u"), F.col("id"), F.lit(" these words are all shared")).alias("source"),
        F.lit("t").alias("target"),
    )
    queries = spark.range(20).select(
        F.concat(F.lit("q"), F.col("id")).alias("pair_id"),
        F.concat(F.lit("v"), F.col("id"), F.lit(" these words are all shared")).alias("source"),
    )
    assert {r["match_rk"] for r in memory.tm_predict(train, queries).collect()} == {1}


def test_no_queries_and_no_sources(spark):
    none, one = [], [("q", "a b")]
    assert memory.tm_predict(*frames(spark, [(1, "a", "t")], none)).count() == 0
    assert memory.tm_predict(*frames(spark, [], one)).first()["n_unmatched"] == 1


def test_salted_join_equals_join(spark):
    left = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("l"))
    right = spark.range(90).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("r"))
    salted = skew.salted_join(left, right, ["k"], ["l"], ["r"], parts=8)
    plain = left.join(right, "k")
    assert salted.select("k", "l", "r").exceptAll(plain.select("k", "l", "r")).count() == 0
    assert salted.count() == plain.count()
    unique = right.groupBy("k").agg(F.max("r").alias("r"))
    assert skew.salted_join(left, unique, ["k"], ["l"], None, how="left", parts=8).count() == 300
    with pytest.raises(ValueError):
        skew.salted_join(left, right, ["k"], ["l"], ["r"], how="left")


def test_weighted_lookup(spark):
    rows = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 9").withColumn("v", F.col("k") * 10)
    got = skew.weighted_lookup(rows, table, ["k"], "n", ["i"], parts=16).collect()
    assert len(got) == 200
    assert all(r["v"] == (None if r["k"] == 9 else r["k"] * 10) for r in got)


def brute_em(pairs, rounds):
    prob = None
    for _ in range(rounds):
        c = defaultdict(float)
        for s, t in pairs:
            s, t = s.split(), t.split()
            for y in t:
                z = sum(prob[x, y] if prob else 1.0 for x in s)
                for x in s:
                    c[x, y] += (prob[x, y] if prob else 1.0) / z
        total = defaultdict(float)
        for (x, _), v in c.items():
            total[x] += v
        prob = {(x, y): v / total[x] for (x, y), v in c.items()}
    return prob


@pytest.mark.parametrize("part", [1 << 20, 3, 1])
def test_lexical_table(spark, monkeypatch, part):
    monkeypatch.setattr(lexicon, "PART_PAIRS", part)
    pairs = [("das haus", "the house"), ("das buch", "the book"), ("ein buch", "a book"), ("", "none"),
             ("das das haus", "the the house")]
    df = spark.createDataFrame([(str(i), s, t) for i, (s, t) in enumerate(pairs)],
                               "pair_id string, source string, target string")
    table = lexicon.lexical_table(df, rounds=3)
    got = {(r["s"], r["t"]): r["prob"] for r in table.collect()}
    expected = brute_em(pairs, 3)
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v)
    queries = spark.createDataFrame([("x", "das buch unknown"), ("y", "")], "pair_id string, source string")
    said = {r["pair_id"]: r["prediction"] for r in lexicon.lexical_predict(table, queries).collect()}
    assert said == {"x": "the book unknown", "y": ""}


def test_what_a_search_stores_does_not_grow_with_queries_times_blocks(spark, small_blocks, monkeypatch):
    """Queries that share frequent words with every block leave at most a row a slice of the blocks."""
    monkeypatch.setattr(nearest, "SLICES", 2, raising=False)
    monkeypatch.setattr(nearest, "GROUP_QUERIES", 8, raising=False)
    rng = random.Random(5)
    lines = [" ".join(["the", "of", *rng.choices([f"w{i}" for i in range(90)], k=8)]) for _ in range(400)]
    train = [(i + 1, line, "") for i, line in enumerate(lines)]
    queries = [(f"q{i}", " ".join(rng.choices(lines[i].split(), k=6)) + f" own{i} the") for i in range(40)]
    stored = {}
    keep = nearest.materialize

    def counted(df, label):
        out = keep(df, label)
        stored[label] = max(stored.get(label, 0), out.count())
        return out

    monkeypatch.setattr(nearest, "materialize", counted)
    best, sets = nearest.best_matches(*frames(spark, train, queries), [nearest.Wanted(0)])
    got = {r.pair_id: r.rk for r in best.join(sets, ["gram_order", "query_key"]).collect()}
    assert got == {k: v[1] for k, v in brute(train, queries).items()}
    assert max(stored[x] for x in stored if x != "source-sets") <= 2 * len(queries)


def test_overlaps_of_a_block_are_counted_in_runs(monkeypatch):
    """Equal to all pairs, with several tiers, scores and runs, ties, and sets of over 255 grams."""
    import pyarrow as pa

    monkeypatch.setattr(nearest, "RUN", 4)
    rng = random.Random(3)
    sources = [sorted(rng.sample(range(400), rng.choice([1, 3, 8, 20, 290]))) for _ in range(60)]
    sources += sources[:10]
    queries = [sorted(rng.sample(range(420), rng.choice([1, 4, 9, 25, 300]))) for _ in range(30)] + [sources[20]]
    wanted = [nearest.Wanted(0), nearest.Wanted(1, 1, 0.5), nearest.Wanted(2, 1, 2.0, 0.3)]
    ranks = rng.sample(range(1, 1000), len(sources))

    def rows(sets, **columns):
        columns["grams"] = pa.array(sets, pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    for several in (0, 1):
        tiers = [several * (rk > 400) for rk in ranks]
        group = nearest._Group(rows(queries, query_key=[str(i) for i in range(len(queries))]), wanted)
        for a, b in ((0, 30), (30, 70)):
            group.meet(nearest._Index(rows(sources[a:b], tier=tiers[a:b], rk=ranks[a:b])))
        for i, q in enumerate(queries):
            for at, w in enumerate(wanted):
                for last in range(several + 1):
                    found = [
                        (w.score(len({*q} & {*s}), len(q), len(s)), -rk)
                        for s, rk, t in zip(sources, ranks, tiers) if {*q} & {*s} and t <= last
                    ]
                    best = max([f for f in found if f[0] >= w.floor], default=(0, 0))
                    got = [(group.best[t][0][at, i], -group.best[t][1][at, i]) for t in range(last + 1)]
                    assert max(got) == (pytest.approx(best[0]), best[1])


def test_blocks_are_bounded_and_hold_every_set_once():
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(rng.choice([1, 2]), str(i), i % 3, i, [i] * rng.randint(1, 30)) for i in range(200)] + [(1, "big", 0, 999, [7] * 90)]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = ["gram_order", *nearest.SOURCE]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 67]), types)], names)
        for i in range(0, len(rows), 67)
    ]
    blocks = [b for batch in nearest._blocks(iter(batches), 10, 60) for b in batch.to_pylist()]
    found = [(b["gram_order"], *(h[c] for c in nearest.SOURCE)) for b in blocks for h in b["held"]]
    assert sorted(found) == sorted(rows)
    for b in blocks:
        sizes = [len(h["grams"]) for h in b["held"]]
        assert len(sizes) <= 10 and (sum(sizes) <= 60 or len(sizes) == 1)


def test_the_lexical_table_is_not_stored_before_it_is_read(spark, monkeypatch):
    """What is stored has no row per word pair, and the table can be read twice without its postings' name."""
    stored, keep = {}, lexicon.materialize

    def counted(df, label):
        out = keep(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(lexicon, "materialize", counted)
    lines = [(str(i), " ".join(f"s{i}x{j}" for j in range(20)), " ".join(f"t{i}x{j}" for j in range(20))) for i in range(30)]
    before = {t.name for t in spark.catalog.listTables()}
    table = lexicon.lexical_table(spark.createDataFrame(lines, "pair_id string, source string, target string"))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert table.count() == 30 * 20 * 20 == table.count()
    assert max(stored.values()) < 30 * 20 * 20
    assert table.agg(F.max("prob")).first()[0] == pytest.approx(1 / 20)


def test_finds_are_not_stored_and_only_copies_meet(spark, small_blocks, monkeypatch):
    """Of equal sources the lowest rank is in a block; what blocks find is read once, not stored."""
    train = [(i + 1, f"w{i % 30} x{i % 30} common", f"t{i}") for i in range(120)]
    queries = [(f"q{i}", f"w{i} own{i} common") for i in range(20)]
    stored = []
    keep = nearest.materialize
    monkeypatch.setattr(nearest, "materialize", lambda df, label: stored.append((label, keep(df, label))) or stored[-1][1])
    sources, asked = frames(spark, train, queries)
    best, sets = nearest.best_matches(sources, asked, [nearest.Wanted(0)])
    got = {r.pair_id: r.rk for r in best.join(sets, ["gram_order", "query_key"]).collect()}
    assert got == {k: v[1] for k, v in brute(train, queries).items()}
    assert "visited" not in {label for label, _ in stored}
    assert all(name.endswith(".zstd.parquet") for _, df in stored for name in df.inputFiles())
    held = nearest.source_sets(sources, (1,), []).selectExpr("explode(held.rk) AS rk")
    assert sorted(r.rk for r in held.collect()) == list(range(1, 31))


def test_a_group_leaves_no_row_that_an_earlier_tier_beats(monkeypatch):
    """Overlaps are counted for a few queries at a time; rows are those that raise the best so far."""
    import pyarrow as pa

    rng = random.Random(5)
    sets = [sorted(rng.sample(range(60), rng.choice([2, 5, 9]))) for _ in range(90)]
    queries = [sorted(rng.sample(range(70), rng.choice([3, 6]))) for _ in range(23)] + [sorted(rng.sample(range(400), 300))]

    def rows(of, **columns):
        columns["grams"] = pa.array(of, pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    def scores(i, tier):
        a = {*queries[i]}
        return [(len(a & {*s}) / len(a | {*s}), -rk) for rk, s in enumerate(sets, 1) if rk <= 30 * (tier + 1)]

    expected = {}
    for i in range(len(queries)):
        before = 0
        for tier in range(3):
            score, back = max(scores(i, tier))
            if score > before:
                expected[str(i), tier] = score, -back
            before = max(before, score)
    for run, counted in ((4, 1), (8, 700), (128, 1 << 20)):
        monkeypatch.setattr(nearest, "RUN", run)
        monkeypatch.setattr(nearest, "COUNTED", counted)
        group = nearest._Group(rows(queries, query_key=[str(i) for i in range(len(queries))]), [nearest.Wanted(0)])
        group.meet(nearest._Index(rows(sets, tier=[(rk - 1) // 30 for rk in range(1, 91)], rk=list(range(1, 91)))))
        found = [row for batch in group.rows(1) for row in batch.to_pylist()]
        got = {(r["query_key"], r["tier"]): (pytest.approx(r["score"]), r["rk"]) for r in found}
        assert len(found) == len(got) and got == expected


def _held(sets, **columns):
    import pyarrow as pa

    grams = pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([*(pa.array(c) for c in columns.values()), grams], [*columns, "grams"])


def _word_sets(random_state, n, words=400):
    """Sets of gram hashes, frequent and rare; some are near copies of the one before."""
    out = []
    for _ in range(n):
        if out and random_state.random() < 0.1:
            out.append(set(list(out[-1])[: max(1, len(out[-1]) - 1)]) | {random_state.randrange(words)})
        else:
            size = random_state.choice([1, 2, 5, 12, 30, 300])
            out.append({int(words * random_state.random() ** 3) for _ in range(size)})
    return out


@pytest.mark.parametrize("sent", [0, 2])
def test_a_block_is_sent_to_a_worker_once_for_all_its_groups(sent):
    import pyarrow as pa

    random_state = random.Random(11)
    sources, queries = _word_sets(random_state, 60), _word_sets(random_state, 30)
    rows = []
    for number in range(2):
        part = sources[30 * number : 30 * number + 30]
        ranks = list(range(30 * number + 1, 30 * number + 31))
        held = _held(part, tier=pa.array([0] * 30, pa.int32()), rk=ranks).to_pylist()
        for group in range(3):
            names = [str(i) for i in range(10 * group, 10 * group + 10)]
            asked = _held(queries[10 * group : 10 * group + 10], query_key=names).to_pylist()
            rows.append({"block": number, "sources": held if group == sent else None, "group": group, "queries": asked})
    batch = pa.RecordBatch.from_pylist(rows)
    wanted = [nearest.Wanted(0), nearest.Wanted(1, 1, 0.5, 0.3)]
    found = {}
    for out in nearest._meetings(iter([batch.slice(0, 2), batch.slice(2)]), 1, wanted):
        found.update({(r["query_key"], r["key"]): (r["score"], r["rk"]) for r in out.to_pylist()})
    for w in wanted:
        for i, q in enumerate(queries):
            scored = [(w.score(len(q & s), len(q), len(s)), -rk) for rk, s in enumerate(sources, 1) if q & s]
            best = max((s for s in scored if s[0] >= w.floor), default=None)
            assert found.get((str(i), w.key)) == (best and (best[0], -best[1]))


@pytest.mark.parametrize("dense", [3, 64])
def test_queries_with_a_bound_do_not_count_their_frequent_grams(monkeypatch, dense):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(nearest, "RUN", 8)
    monkeypatch.setattr(nearest, "DENSE", dense)
    random_state = random.Random(5)
    sources, queries = _word_sets(random_state, 600), _word_sets(random_state, 200)
    wanted = [nearest.Wanted(0), nearest.Wanted(1, 1, 0.5, 0.4), nearest.Wanted(2, 1, 2.0, 0.3)]
    spared, by_lists = [], []
    left_out, meet_lists = nearest._Index.left_out, nearest._Group._meet_lists

    def noted(self, *rest):
        level, number = left_out(self, *rest)
        spared.append(int(number.sum()))
        return level, number

    def noted_lists(self, block, asked, *rest):
        by_lists.append(len(asked))
        return meet_lists(self, block, asked, *rest)

    monkeypatch.setattr(nearest._Index, "left_out", noted)
    monkeypatch.setattr(nearest._Group, "_meet_lists", noted_lists)
    for some in (wanted, wanted[1:]):
        for tiers in (1, 3):
            group = nearest._Group(_held(queries, query_key=[str(i) for i in range(len(queries))]), some)
            for a in range(0, 600, 150):
                tier = [i % tiers for i in range(150)]
                group.meet(nearest._Index(_held(sources[a : a + 150], tier=pa.array(tier, pa.int32()), rk=list(range(a + 1, a + 151)))))
            for at, w in enumerate(some):
                for i, q in enumerate(queries):
                    # Scores of a tier are kept where none of the tiers before beats them.
                    best, before = {}, 0.0
                    for t in range(tiers):
                        scored = [
                            (w.score(len(q & s), len(q), len(s)), -(rk + 1))
                            for rk, s in enumerate(sources) if q & s and (rk % 150) % tiers == t
                        ]
                        top = max((s for s in scored if s[0] >= w.floor), default=None)
                        if top and top[0] > before:
                            best[t], before = top, top[0]
                    found = {}
                    for t, (score, rank) in group.best.items():
                        if score[at][i] > max([0.0, *(v[0] for k, v in found.items() if k < t)]):
                            found[t] = (score[at][i], -rank[at][i])
                    assert found == best
    assert sum(by_lists) if dense == 3 else sum(spared)
    assert np.array_equal(nearest._order(np.array([5, 4, 5, -1])), [3, 1, 0, 2])


def test_grams_are_cut_alike_in_all_slices(spark, monkeypatch):
    texts = ["a b a b", None, " ", "b a\tc", "a b", "c"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "pair_id long, source string").coalesce(1)
    monkeypatch.setattr(nearest, "TEXT_BYTES", 8)
    sets = {(r["pair_id"], r["gram_order"]): r["grams"] for r in nearest.gram_sets(rows, ["pair_id"], "source", (1, 2)).collect()}
    of = {}
    for (i, n), grams in sets.items():
        words = texts[i].split()
        expected = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        assert grams == sorted(set(grams)) and len(grams) == len(expected)
        assert of.setdefault(frozenset(expected), grams) == grams
    assert len(sets) == sum(len(t.split()) >= n for t in texts if t for n in (1, 2))
    assert len({tuple(g) for g in of.values()}) == len(of)


def test_postings_are_stored_with_zstandard(spark):
    pairs = spark.createDataFrame([("p", "a b", "c d"), ("q", "a", "d")], "pair_id string, source string, target string")
    postings, _, name = lexicon._postings(pairs)
    files = postings.inputFiles()
    assert postings.count() == 3 and files and all(f.endswith(".zstd.parquet") for f in files)
    spark.sql(f"DROP TABLE `{name}`")
