import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import splits
from pairloom.operators.ranking import bucketed_rank, ordered_chunks, running, scan
from pairloom.sources import pairs as pair_source


def corpus(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("pair_id"),
        F.concat(F.lit("word "), F.col("id")).alias("source"),
        F.lit("one two three").alias("target"),
    )


@pytest.mark.parametrize("n", [1, 7, 10, 233, 1000])
def test_exact_sizes_and_ranks(spark, n):
    out = splits.exact_split(corpus(spark, n))
    rest = math.ceil((1 - 0.8) * n)
    test = math.ceil((1 - 0.1 / (0.1 + 0.1)) * rest)
    expected = {"train": n - rest, "val": rest - test, "test": test}
    rows = out.select("pair_id", "split", "rk").collect()
    assert len({r["pair_id"] for r in rows}) == n
    for name, size in expected.items():
        assert sorted(r["rk"] for r in rows if r["split"] == name) == list(range(1, size + 1))


def test_exact_split_does_not_depend_on_partitions(spark):
    one = splits.exact_split(corpus(spark, 300).repartition(1)).select("pair_id", "split", "rk")
    many = splits.exact_split(corpus(spark, 300).repartition(9)).select("pair_id", "split", "rk")
    assert one.exceptAll(many).count() == 0


def test_hash_split_is_stable_when_rows_are_added(spark):
    few = {r["pair_id"]: r["split"] for r in splits.hash_split(corpus(spark, 200), "pair_id").collect()}
    more = {r["pair_id"]: r["split"] for r in splits.hash_split(corpus(spark, 400), "pair_id").collect()}
    assert all(more[k] == v for k, v in few.items())
    assert set(more.values()) == {"train", "val", "test"}


def test_ratios(spark):
    with pytest.raises(ValueError):
        splits.exact_split(corpus(spark, 5), train=0.8, val=0.1, test=0.2)


def test_prefixes_nest(spark):
    train = splits.exact_split(corpus(spark, 100)).where("split = 'train'")
    small = {r["pair_id"] for r in splits.prefix(train, 10).collect()}
    large = {r["pair_id"] for r in splits.prefix(train, 30).collect()}
    assert len(small) == 10 and small < large
    assert splits.prefix(train, 5000).count() == 80
    sizes = splits.sizes_up_to(train, [10, 50, 80, 500], 90)
    assert [tuple(r) for r in sizes.orderBy("run_seq").collect()] == [(1, 10), (2, 50), (3, 80), (5, 80)]
    stats = splits.nested_prefix_stats(train, sizes).orderBy("run_seq").collect()
    assert [r["n_pairs"] for r in stats] == [10, 50, 80, 80]
    assert [r["source_words"] for r in stats] == [20, 100, 160, 160]


def test_leakage(spark):
    df = spark.createDataFrame(
        [("a", "train"), ("A ", "test"), ("b", "val"), ("b", "val"), ("c", "train")], "t string, split string"
    )
    found = splits.leakage(df, F.lower(F.trim("t"))).collect()
    assert [(r["n_train"], r["n_val"], r["n_test"]) for r in found] == [(1, 0, 1)]


def test_stored_splits(spark, tmp_path):
    path = str(tmp_path / "splits")
    with pytest.raises(FileNotFoundError):
        pair_source.read_splits(spark, path)
    calls = []

    def create():
        calls.append(1)
        return splits.exact_split(corpus(spark, 50))

    first = pair_source.splits_or_create(spark, path, create)
    second = pair_source.splits_or_create(spark, path, create)
    assert len(calls) == 1 and first.count() == second.count() == 50
    assert pair_source.stored_counts(spark, path) == {"train": 40, "val": 5, "test": 5}
    plan = second.where("split = 'val'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_interrupted_write_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "splits")
    whole = splits.exact_split(corpus(spark, 20))
    broken = whole.withColumn("source", F.when(F.col("rk") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("source")))
    with pytest.raises(Exception, match="lost"):
        pair_source.write_splits(broken, path)
    (tmp_path / "splits" / "data-half" / "split=train").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        pair_source.read_splits(spark, path)
    assert pair_source.splits_or_create(spark, path, lambda: whole).count() == 20
    pair_source.write_splits(whole.limit(3), path)
    assert pair_source.read_splits(spark, path).count() == 20


def test_json_sources(spark, tmp_path):
    array = tmp_path / "pairs.json"
    array.write_text('[{"source": "hå", "target": "ha"}, {"target": "only"}, {"source": null}]', encoding="utf-8")
    df = pair_source.read_json_array(spark, str(array))
    assert {tuple(r) for r in df.collect()} == {("hå", "ha"), (None, "only"), (None, None)}
    out = str(tmp_path / "lines")
    pair_source.write_json_lines(df, out)
    assert pair_source.read_json_lines(spark, out).exceptAll(df).count() == 0


def skewed(spark):
    """One key holds most of the rows."""
    return spark.range(500).select(
        F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 10)).alias("run"),
        F.col("id").alias("at"),
        ((F.col("id") * 7919) % 1000).alias("v"),
    )


def test_running_values_over_chunks(spark):
    chunks = ordered_chunks(skewed(spark), ["run"], ["at"])
    hot = chunks.where("run = 'hot'").select("chunk").distinct().count()
    assert hot > 1
    got = running(chunks, ["run"], ["at"], {"n": ("sum", F.lit(1)), "top": ("max", F.col("v"))})
    before = running(chunks, ["run"], ["at"], {"prev": ("max", F.col("v"))}, inclusive=False)
    prev = {(r["run"], r["at"]): r["prev"] for r in before.collect()}
    seen = {}
    for r in sorted(got.collect(), key=lambda r: r["at"]):
        values = seen.setdefault(r["run"], [])
        assert prev[(r["run"], r["at"])] == (max(values) if values else None)
        values.append(r["v"])
        assert (r["n"], r["top"]) == (len(values), max(values))


def test_bucketed_rank(spark):
    df = spark.range(100).withColumn("b", F.floor(F.col("id") / 7)).withColumn("g", F.col("id") % 2)
    assert all(r["rank"] == r["id"] + 1 and r["rank_of"] == 100 for r in bucketed_rank(df, ["b"], ["id"]).collect())
    assert all(r["rank"] == r["id"] // 2 + 1 for r in bucketed_rank(df, ["b"], ["id"], per=["g"]).collect())


@pytest.mark.parametrize("batch", [3, 10_000])
def test_scan_equals_windows(spark, batch):
    """A hot key, a null key, nulls, ties: one exchange gives what a window per key gives."""
    pick = random.Random(batch)
    rows = [
        (pick.choice(["hot", "hot", "hot", "b", "c", None]), i, pick.choice([None, 1, 2, 2, 5, 9]), pick.random())
        for i in range(200)
    ]
    frame = spark.createDataFrame(rows, "run string, at long, v long, x double").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = scan(
            frame, ["run"], ["at"],
            {"total": ("sum", F.col("v")), "top": ("max", F.col("x")), "low": ("min", F.col("v")),
             "since": ("first_max", F.col("v"))},
        ).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 200
    for run in {r[0] for r in rows}:
        seen, mine = [], sorted((r for r in got if r["run"] == run), key=lambda r: r["at"])
        for n, r in enumerate(mine, 1):
            seen.append((r["v"], r["x"]))
            values = [v for v, _ in seen if v is not None]
            assert r["step"] == n
            assert r["top"] == max(x for _, x in seen)
            assert (r["total"], r["low"]) == ((sum(values), min(values)) if values else (None, None))
            first = next((i for i, (v, _) in enumerate(seen, 1) if values and v == max(values)), None)
            assert r["since"] == first


def test_scan_moves_rows_once(spark):
    plan = scan(spark.range(50).withColumn("k", F.col("id") % 3), ["k"], ["id"], {"s": ("sum", F.col("id"))})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert scan(spark.range(0).withColumn("k", F.lit(1)), ["k"], ["id"], {}).count() == 0


def test_rows_of_no_rank_asked_for_do_not_move(spark, monkeypatch):
    """Ranks are those of all rows; of 400 only those of a few buckets reach the window."""
    from pairloom.operators import ranking

    whole = splits.exact_split(corpus(spark, 400))
    for ranks in ({"train": 30, "val": None}, {"val": 3, "test": 2}, {"train": 1000}, {"test": None}):
        some = splits.exact_split(corpus(spark, 400), ranks=ranks)
        asked = [(F.col("split") == s) & (F.lit(n is None) | (F.col("rk") <= (n or 0))) for s, n in ranks.items()]
        expected = whole.where(asked[0] | asked[-1])
        assert some.exceptAll(expected).count() == expected.exceptAll(some).count() == 0
    seen = []
    monkeypatch.setattr(
        splits, "bucketed_rank", lambda *a, **k: seen.append(ranking.bucketed_rank(*a, **k)) or seen[-1]
    )
    splits.exact_split(corpus(spark, 400), ranks={"train": 30, "val": None})
    assert 70 <= seen[0].count() < 80


def test_a_sweep_reads_what_its_sizes_ask_for(spark, tmp_path, monkeypatch):
    from pairloom.plans import queries, sweeps

    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.col("id") % 9), lambda i: F.concat(F.lit("line "), i)))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), text.alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = queries.line_corpus(spark, str(tmp_path))
    n_val = whole.where("split = 'val'").count()
    for sizes, last in (((5, 9), 14), ((5, 900), 700)):
        monkeypatch.setattr(sweeps, "DATA_SIZES", sizes)
        monkeypatch.setattr(sweeps, "LAST_SIZE", last)
        some = queries.sweep_corpus(spark, str(tmp_path))
        expected = whole.where(f"split = 'val' OR split = 'train' AND rk <= {max(*sizes, last)}")
        assert some.exceptAll(expected).count() == expected.exceptAll(some).count() == 0
        whole_sizes, sizes_ = (
            sweeps.sweep_sizes(c.where("split = 'train'").count(), sizes, last) for c in (whole, some)
        )
        assert whole_sizes == sizes_ and some.where("split = 'val'").count() == n_val > 0
