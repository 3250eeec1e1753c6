import json
import os
import shutil
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.operators import batching, checkpoints, hooks, metrics, runs
from pairloom.plans import sweeps
from pairloom.plans.queries import REGISTRY
from pairloom.sources import runs as source
from pairloom.sources.runs import event_log
from pairloom.streaming import metric_log

SCHEMA = (
    "run_seq long, phase string, data_size long, r int, alpha int, dropout double, "
    "bleu double, chrf double, loss double, failed boolean"
)


def table(spark, rows):
    """rows: (run_seq, phase, size, bleu or None for a failed run)."""
    full = [
        (seq, phase, size, 8, 16, 0.1, b or 0.0, (b or 0.0) * 100, 999.0 if b is None else 1 - b,
         True if b is None else None)
        for seq, phase, size, b in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


NONE_FAILED = [(1, "1", 500, 0.19), (2, "1", 1000, 0.20), (3, "2", 3000, 0.20)]
SOME_FAILED = [(1, "1", 500, None), (2, "1", 1000, 0.30), (3, "2", 3000, None)]
ALL_FAILED = [(1, "1", 500, None), (2, "1", 1000, None)]


@pytest.mark.parametrize(
    "rows, expected",
    [(NONE_FAILED, (1000, 500)), (SOME_FAILED, (1000, 1000)), (ALL_FAILED, (500, 500)), ([], (500, 500)),
     ([(1, "1", 2000, 0.0)], (500, 500))],
)
def test_recommendation(spark, rows, expected):
    df = table(spark, rows)
    assert tuple(runs.recommendation(df).first()) == expected
    doc = runs.summary_document(df, max_runs=7).first()
    assert (doc["optimal_size"], doc["recommended_size"]) == expected
    assert [r["data_size"] for r in doc["all_results"]] == [r[2] for r in rows]


def test_near_best_is_inclusive_and_ties_take_the_first(spark):
    df = table(spark, [(3, "1", 700, 0.4), (1, "1", 900, 0.4), (2, "1", 300, 0.4 * 0.95), (4, "1", 100, 0.37)])
    assert {r["run_seq"] for r in runs.near_best_runs(df).collect()} == {1, 2, 3}
    assert runs.best_run(df).first()["run_seq"] == 1
    assert tuple(runs.recommendation(df).first()) == (900, 300)


def test_summary_of_too_many_runs_raises(spark):
    with pytest.raises(Exception, match="too many runs"):
        runs.summary_document(table(spark, NONE_FAILED), max_runs=2).collect()


def test_best_config_default(spark):
    assert tuple(runs.best_config(table(spark, ALL_FAILED)).first()) == (16, 32, 0.1, 0.0)
    assert tuple(runs.best_config(table(spark, NONE_FAILED)).first()) == (8, 16, 0.1, 0.2)


def test_gates(spark):
    def gate(rows):
        return {r["phase"]: r["goes_on"] for r in runs.phase_gate(table(spark, rows)).collect()}

    assert gate(NONE_FAILED) == {"1": True, "2": True, "3": False}
    assert gate(ALL_FAILED) == {"1": False, "2": False, "3": False}
    assert gate([(1, "1", 500, 0.14), (2, "2", 3000, 0.01)]) == {"1": False, "2": True, "3": False}
    reached = runs.gated_runs(table(spark, [(1, "1", 500, 0.14), (2, "2", 3000, 0.9)]))
    assert [r["run_seq"] for r in reached.collect()] == [1]


def test_append_without_failed_column(spark):
    valid = table(spark, NONE_FAILED).drop("failed")
    both = runs.all_runs([valid, table(spark, SOME_FAILED)])
    assert both.count() == 6 and runs.valid_runs(both).count() == 4


def test_defaults_of_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "recommended_size long")
    assert runs.size_or_default(empty).first()[0] == 2000
    docs = spark.createDataFrame([('{"r": 8}',), ('{"r": 32, "alpha": 64, "dropout": 0.2}',), ("{}",)], "d string")
    parsed = [tuple(r["c"]) for r in docs.select(source.parse_config(F.col("d")).alias("c")).collect()]
    assert parsed == [(8, 32, 0.1), (32, 64, 0.2), (16, 32, 0.1)]
    bad = spark.createDataFrame([("{broken",)], "d string")
    with pytest.raises(Exception):
        bad.select(source.parse_config(F.col("d"))).collect()


def test_sentinel(spark):
    attempted = spark.createDataFrame([(1, 500), (2, 1000)], "run_seq long, data_size long")
    scores = spark.createDataFrame([(2, 0.2, 20.0, 0.8)], "run_seq long, bleu double, chrf double, loss double")
    rows = {r["run_seq"]: r for r in runs.with_sentinel(attempted, scores).collect()}
    assert tuple(rows[1])[2:] == (0.0, 0.0, 999.0, True)
    assert rows[2]["failed"] is None


def test_files(spark, tmp_path):
    df = table(spark, SOME_FAILED).select("data_size", "bleu", "chrf", "loss", "failed")
    path = str(tmp_path / "runs")
    source.write_run_csv(df, path)
    back = source.read_run_csv(spark, path)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    old = tmp_path / "old.csv"
    old.write_text("data_size,bleu,chrf,failed\n700,0.0,0.0,True\n")
    assert tuple(source.read_run_csv(spark, str(old)).first()) == (700, 0.0, 0.0, None, True)
    size = str(tmp_path / "size")
    source.write_scalar(spark.createDataFrame([(1500,)], "v int"), size)
    assert source.read_scalar(spark, size).first()[0] == 1500
    document = str(tmp_path / "summary")
    source.write_document(runs.summary_document(table(spark, NONE_FAILED), 7), document)
    again = spark.read.schema(source.SUMMARY_SCHEMA).json(document).first()
    assert again["recommended_size"] == 500 and len(again["all_results"]) == 3
    assert again["all_results"][0]["failed"] is None


def test_run_folders(spark, tmp_path):
    for size, step, log in ((300, 30, [{"epoch": 1.5, "loss": 1.2, "learning_rate": 1e-4, "step": 20}]), (600, 60, [])):
        folder = tmp_path / f"data_size_{size}" / f"checkpoint-{step}"
        folder.mkdir(parents=True)
        (folder / "trainer_state.json").write_text(json.dumps(
            {"global_step": step, "best_metric": None, "log_history": log}, indent=1))
        (folder / "adapter_config.json").write_text(json.dumps(
            {"r": 4, "lora_alpha": 8, "lora_dropout": 0.0, "target_modules": ["a", "b"], "alpha_pattern": {}}))
    rows = source.read_run_folders(spark, str(tmp_path)).orderBy("data_size").collect()
    assert [(r["data_size"], r["checkpoint"], r["log_step"], r["r"]) for r in rows] == [
        (300, 30, 20, 4), (600, 60, None, 4)]
    codes = tmp_path / "codes.json"
    codes.write_text(json.dumps({"additional_special_tokens": ["x_Latn", "y_Cyrl"], "pad_token": {"content": "<pad>"}}))
    assert {r["code"] for r in source.read_language_codes(spark, str(codes)).collect()} == {"x_Latn", "y_Cyrl"}


def log(spark, values, run="a"):
    rows = [(i, run, f"2024-01-{1 + i // 4:02d} {i % 4:02d}:00:00", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, run string, t string, metric double")
    return df.withColumn("ts", F.to_timestamp("t")).drop("t")


@pytest.mark.parametrize(
    "values, stop",
    [([1, 2, 3, 4], None), ([5, 1, 1, 1, 9], 4), ([1, 2, 2, 2, 3, 0, 0, 0], 8), ([3, 3, 3, 3], 4), ([1], None)],
)
def test_early_stop(spark, values, stop):
    row = checkpoints.early_stops(checkpoints.numbered_log(log(spark, values))).first()
    assert (row["n_steps"], row["stop_step"]) == (len(values), stop)


def test_best_checkpoints_keep_last_two(spark):
    numbered = checkpoints.numbered_log(log(spark, [1, 1, 9, 9, 2, 2, 9, 9, 3, 3]))
    kept = checkpoints.best_checkpoints(checkpoints.logged_means(numbered, 2)).orderBy("step").collect()
    assert [(r["step"], r["is_best"]) for r in kept] == [(4, True), (8, False), (10, False)]


def test_streams_equal_batch(spark, tmp_path):
    """Three files, one repeated row and one late row."""
    entries = log(spark, [5, 7, 1, 4, 8, 8, 2, 3, 6, 9, 0, 1])
    inbox = str(tmp_path / "in")
    late = entries.where("event_id = 2")
    for part in (
        entries.where("event_id < 5 AND event_id <> 2"),
        entries.where("event_id BETWEEN 4 AND 8").unionByName(late),
        entries.where("event_id > 8"),
    ):
        part.coalesce(1).write.mode("append").parquet(inbox)
    stream = (
        spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1)
        .option("latestFirst", False).parquet(inbox)
    )
    out = str(tmp_path / "log")
    metric_log.append_log(stream, out, str(tmp_path / "s1"), delay=None).awaitTermination()
    stored = spark.read.parquet(out)
    assert sorted(r["event_id"] for r in stored.collect()) == list(range(12))
    files = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(out)
    metric_log.window_stream(files, str(tmp_path / "w"), str(tmp_path / "s2"), delay=None).awaitTermination()
    got = metric_log.read_windows(spark, str(tmp_path / "w"))
    assert got.exceptAll(checkpoints.metric_windows(entries).select(*got.columns)).count() == 0
    assert got.count() == 3
    files = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(out)
    metric_log.best_stream(files, str(tmp_path / "b"), str(tmp_path / "s3")).awaitTermination()
    best = metric_log.read_best(spark, str(tmp_path / "b")).first()
    assert (best["event_id"], best["metric"]) == (9, 9.0)
    assert checkpoints.best_per_run(entries).first()["event_id"] == 9


def test_hooks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cde")], "k int, t string")

    def lengths(batch):
        return pa.RecordBatch.from_arrays([pa.array([len(v.as_py()) for v in batch.column("t")], pa.int32())], ["n"])

    assert sorted(r["n"] for r in hooks.map_batches(df, lengths, "n int").collect()) == [2, 3]
    predicted = spark.createDataFrame([("a", "1", "x y", "x y"), ("b", "2", "x", "z")],
                                      "run string, pair_id string, prediction string, reference string")
    count = lambda d, by: d.groupBy(*by).agg(F.count("*").alias("rows"))
    out = hooks.evaluate(predicted, [metrics.corpus_chrf, count], ["run"]).orderBy("run").collect()
    assert [(r["run"], r["chrf"], r["rows"]) for r in out] == [("a", 100.0, 1), ("b", 0.0, 1)]


def test_padding_and_masks(spark):
    df = spark.createDataFrame(
        [(i, "train", i + 1, ["w"] * (1 + i % 3)) for i in range(10)], "i int, split string, rk long, t array<string>")
    rows = batching.padded(batching.with_batches(df), "t").collect()
    assert all(len(r["padded"]) == r["width"] for r in rows)
    assert {r["batch_id"]: r["width"] for r in rows} == {0: 3, 1: 3}
    by_length = batching.waste(batching.length_batches(df, "t", 5), "t").first()
    assert by_length["n_batches"] == 2 and by_length["used"] == 19
    labels = spark.createDataFrame([([5, -100, -100],)], "l array<int>")
    assert labels.select(batching.unmask(F.col("l"), 1).alias("x")).first()["x"] == [5, 1, 1]


def test_lazy_phases_stop(spark):
    memory = spark.createDataFrame([(i + 1, f"w{i} common words", f"t{i}") for i in range(20)],
                                   "rk long, source string, target string")
    queries = spark.createDataFrame([("q", "w3 common words", "t3")], "pair_id string, source string, target string")
    phases = {"1": [(1, 5)], "2": [(2, 20)]}
    stopped = sweeps.phased_sweep(memory, queries, phases, {"1": 2.0})
    assert [r["phase"] for r in stopped.collect()] == ["1"]
    both = sweeps.phased_sweep(memory, queries, phases, {"1": None})
    assert sorted(r["phase"] for r in both.collect()) == ["1", "2"]
    assert sweeps.sweep_sizes(700) == [(1, 500), (7, 700)]
    whole = sweeps.scaling_sweep(memory, queries, [(1, 5), (2, 20)]).orderBy("run_seq").collect()
    assert [r.asDict() for r in whole] == [r.asDict() for r in both.drop("phase").orderBy("run_seq").collect()]
    with pytest.raises(ValueError):
        sweeps.phased_sweep(memory, queries, {"1": [(1, 9)], "2": [(2, 5)]}, {})


@pytest.mark.parametrize("as_folder", [False, True])
def test_registered_streams_lose_nothing(spark, tmp_path, sf_dir, as_folder):
    """One file, or parts in random time order: the streams give what the batch gives."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    target = f"{tmp_path}/events.parquet"
    if as_folder:
        events.repartition(5, F.xxhash64("event_id")).write.parquet(target)
    else:
        shutil.copy(f"{sf_dir}/events.parquet", target)
    for name in ("metric_log", "metric_windows", "best_per_run"):
        streamed = REGISTRY[f"stream_{name}"](spark, str(tmp_path))
        batch = {
            "metric_log": lambda s, d: event_log(s, d),
            "metric_windows": REGISTRY["metric_windows"],
            "best_per_run": lambda s, d: checkpoints.best_per_run(event_log(s, d)),
        }[name](spark, str(tmp_path)).select(*streamed.columns)
        assert streamed.count() == batch.count() > 0
        shown = lambda df: sorted(str([v for k, v in r.asDict().items() if k != "ts"]) for r in df.collect())
        assert shown(streamed) == shown(batch)


def test_phases_follow_their_list(spark):
    rows = [(1, "2", 500, 0.05), (2, "10", 1000, 0.9)]
    table = spark.createDataFrame(rows, "run_seq long, phase string, data_size long, bleu double")
    table = table.withColumn("failed", F.lit(False))
    reached = runs.gated_runs(table, {"2": 0.15, "10": None})
    assert [r["phase"] for r in reached.collect()] == ["2"]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """From another folder, with the package on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pairloom.plans.queries import REGISTRY\n"
        "from pairloom.session import build_session\n"
        "s = build_session('local[2]', **{'spark.sql.shuffle.partitions': '2', 'spark.ui.enabled': 'false'})\n"
        "print(REGISTRY['corpus_bleu'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=170
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.split()[-1] == "1"


def test_absent_documents_give_defaults(spark, tmp_path):
    assert source.read_size(spark, f"{tmp_path}/none").first()["value"] == 2000
    assert tuple(source.read_config(spark, f"{tmp_path}/none").first()) == (16, 32, 0.1)
    (tmp_path / "part.json").write_text('{"r": 8}')
    assert tuple(source.read_config(spark, f"{tmp_path}/part.json").first()) == (8, 32, 0.1)
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception):
        source.read_config(spark, f"{tmp_path}/bad.json").collect()


def test_metric_of_batches_is_added_up_by_key(spark):
    rows = [("a", "1", "x y"), ("a", "2", "x"), ("b", "3", ""), (None, "4", "x y z")]
    frame = spark.createDataFrame(rows, "run string, pair_id string, text string").repartition(4)

    def partial(batch):
        seen = {}
        for run, text in zip(batch.column("run").to_pylist(), batch.column("text").to_pylist()):
            words, n = seen.get(run, (0.0, 0.0))
            seen[run] = (words + len(text.split()), n + 1)
        columns = [pa.array(list(seen), pa.string())]
        columns += [pa.array([v[i] for v in seen.values()], pa.float64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["run", "words", "n"])

    found = hooks.batch_metric(frame, ["run"], partial, ["words", "n"], {"mean": F.col("words") / F.col("n")})
    assert {r["run"]: r["mean"] for r in found.collect()} == {"a": 1.5, "b": 0.0, None: 3.0}


def test_score_column_comes_along(spark):
    rows = [("a", "1", "x y", "x y", 0.5), ("a", "2", "x", "z", 1.5), ("b", "3", "q", "q", None)]
    frame = spark.createDataFrame(rows, "run string, pair_id string, prediction string, reference string, s double")
    got = {r["run"]: r for r in metrics.all_metrics(frame, ["run"], score="s").collect()}
    assert (got["a"]["score_mean"], got["a"]["score_std"], got["b"]["score_mean"]) == (1.0, 0.5, 0.0)
    plain = metrics.all_metrics(frame, ["run"]).collect()
    assert all(got[r["run"]][c] == r[c] for r in plain for c in ("bleu", "chrf", "n_segments"))


def test_width_is_found_before_texts_are_encoded(spark):
    from pairloom.operators import batching

    texts = [None, "", " a ", "a b c", " ".join("x" * 126), " ".join("x" * 300), "a\u3000b\x85"] * 3
    rows = [("s", i + 1, "en", t, t) for i, t in enumerate(texts)]
    df = batching.with_batches(spark.createDataFrame(rows, "split string, rk long, lang string, source string, target string"))
    early = batching.pad(
        batching.encode_pairs(batching.with_width(df, batching.encoded_size(F.col("target")))), "label_tokens"
    )
    late = batching.padded(batching.encode_pairs(df), "label_tokens")
    fields = ["rk", "width", "padded"]
    assert early.select(*fields).orderBy("rk").collect() == late.select(*fields).orderBy("rk").collect()


def test_texts_of_a_sweep_are_counted_in_several_tasks_a_core(spark, monkeypatch):
    memory = spark.createDataFrame([(i + 1, f"w{i} common words", f"t{i}") for i in range(20)],
                                   "rk long, source string, target string")
    queries = spark.createDataFrame([(f"q{i}", f"w{i} common words", f"t{i}") for i in range(30)],
                                    "pair_id string, source string, target string")
    tasks = []
    stats = sweeps.segment_stats
    monkeypatch.setattr(sweeps, "segment_stats", lambda df, *a: tasks.append(df.rdd.getNumPartitions()) or stats(df, *a))
    swept = sweeps.scaling_sweep(memory, queries, [(1, 5), (2, 20)]).orderBy("run_seq").collect()
    assert [r["n_matched"] for r in swept] == [30, 30]
    assert tasks == [4 * spark.sparkContext.defaultParallelism]
