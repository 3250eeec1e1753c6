"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.schedule import eval_interval, save_interval, total_steps, warmup_rate
from pairloom.functions.text import (
    SUPPORTED_CODES,
    decode,
    language_code,
    strip,
    tokens_13a,
    word_count,
    words,
)
from pairloom.operators import batching, checkpoints, hooks, lexicon, metrics, runs, splits
from pairloom.operators.memory import tm_predict as predict_from_memory
from pairloom.plans import sweeps
from pairloom.session import fresh_path, materialize, spread, table
from pairloom.sources.pairs import (
    conversation_pairs,
    line_pairs,
    read_json_lines,
    splits_or_create,
    stored_counts,
    write_json_lines,
)
from pairloom.sources.runs import (
    event_log,
    event_log_stream,
    event_runs,
    parse_config,
    read_config,
    read_run_csv,
    read_size,
    write_document,
    write_run_csv,
    write_scalar,
)
from pairloom.streaming import metric_log

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

PHASE_SIZES = {"1": (500, 1000, 2000), "2": (3000, 5000), "3": (10000,)}
# A gate that the best run of the first phase passes, beside the reference's, which it does not.
LOWER_GATES = {"1": 0.1, "2": None, "3": None}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def line_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line pairs of all documents with exact splits, stored once."""
    return materialize(splits.exact_split(line_pairs(spark, sf_dir)), "line-corpus")


def sweep_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``line_corpus`` that a size sweep reads: validation, and training up to the largest size."""
    ranks = {"train": max(*sweeps.DATA_SIZES, sweeps.LAST_SIZE), "val": None}
    return materialize(splits.exact_split(line_pairs(spark, sf_dir), ranks=ranks), "sweep-corpus")


def _train(corpus: DataFrame) -> DataFrame:
    return corpus.where("split = 'train'")


def _copy_predictions(pairs: DataFrame, *keep: str) -> DataFrame:
    """The do-nothing system: each source is its own prediction."""
    return pairs.select(
        *keep, "pair_id", F.col("source").alias("prediction"), F.col("target").alias("reference")
    )


# --- sources -----------------------------------------------------------------


@query
def scan_pairs(spark, sf_dir):
    """Pairs written as JSON Lines and read back under the explicit schema."""
    path = fresh_path(spark, "pairs-json")
    write_json_lines(conversation_pairs(spark, sf_dir).select("source", "target"), path)
    return read_json_lines(spark, path)


@query
def corpus_stats(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir).select(
        word_count(F.col("source")).alias("s"), word_count(F.col("target")).alias("t")
    )
    return pairs.agg(
        F.count("*").alias("size"),
        F.round(F.coalesce(F.sum("s") / F.count("*"), F.lit(0.0)), 9).alias("avg_source_length"),
        F.round(F.coalesce(F.sum("t") / F.count("*"), F.lit(0.0)), 9).alias("avg_target_length"),
        F.max("s").alias("max_source_length"),
        F.max("t").alias("max_target_length"),
    )


@query
def lang_code_check(spark, sf_dir):
    """Documents per language and whether its code is a listed one."""
    docs = table(spark, sf_dir, "documents").select("lang").groupBy("lang").agg(
        F.count("*").alias("n_docs")
    )
    listed = spark.createDataFrame([(c,) for c in SUPPORTED_CODES], "code string")
    coded = docs.withColumn("code", language_code(F.col("lang")))
    known = coded.join(F.broadcast(listed), "code", "left_semi").withColumn("known", F.lit(True))
    other = coded.join(F.broadcast(listed), "code", "left_anti").withColumn("known", F.lit(False))
    return known.unionByName(other).select("lang", "code", "n_docs", "known")


# --- splits ------------------------------------------------------------------


@query
def split_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.exact_split(docs, "doc_id").select("doc_id", "split", "rk")


@query
def split_counts(spark, sf_dir):
    return splits.split_counts(splits.exact_split(line_pairs(spark, sf_dir).select("pair_id")))


@query
def split_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.hash_split(docs, "doc_id")


@query
def split_grouped(spark, sf_dir):
    """All pairs of a conversation in one split."""
    pairs = conversation_pairs(spark, sf_dir).select("pair_id", "conv_id")
    return splits.hash_split(pairs, "conv_id")


@query
def subset_prefix(spark, sf_dir):
    """First 500 documents of the training order."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    train = splits.exact_split(docs, "doc_id").where("split = 'train'")
    return splits.prefix(train, 500).select("doc_id", "rk")


@query
def nested_prefix_stats(spark, sf_dir):
    train = _train(line_corpus(spark, sf_dir))
    sizes = splits.sizes_up_to(train, list(sweeps.DATA_SIZES), sweeps.LAST_SIZE)
    return splits.nested_prefix_stats(train, sizes)


@query
def split_leakage(spark, sf_dir):
    """Source texts that stand in more than one split."""
    pairs = splits.hash_split(line_pairs(spark, sf_dir).select("pair_id", "source"), "pair_id")
    return splits.leakage(pairs, F.lower(strip(F.col("source"))))


@query
def split_shared_ids(spark, sf_dir):
    """Documents whose lines a split by line puts into more than one split."""
    pairs = splits.hash_split(line_pairs(spark, sf_dir).select("pair_id", "doc_id"), "pair_id")
    return splits.shared_ids(pairs, "doc_id")


@query
def stored_splits(spark, sf_dir):
    """Splits created once and read back through their manifest, with the counts it states."""
    path = fresh_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    for _ in range(2):  # the second call finds what the first has stored
        stored = splits_or_create(spark, path, lambda: splits.exact_split(docs, "doc_id"))
    counts = F.create_map(*[F.lit(x) for pair in stored_counts(spark, path).items() for x in pair])
    return stored.select("doc_id", "split", "rk", counts[F.col("split")].alias("n_split"))


# --- text --------------------------------------------------------------------


@query
def tokenize_13a(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tokens = docs.select("doc_id", tokens_13a(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5")
    )


@query
def token_normalise(spark, sf_dir):
    """Strip, split, tag, cut to the input length, and decode again."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    encoded = docs.select(
        "doc_id",
        F.length(strip(F.col("text"))).alias("n_chars"),
        words(F.col("text")).alias("w"),
        language_code(F.col("lang")).alias("code"),
    ).select(
        "doc_id", "n_chars", "code",
        F.size("w").alias("n_words"),
        batching.is_truncated(F.col("w")).alias("was_truncated"),
        batching.encode(F.col("w"), F.col("code")).alias("e"),
    )
    return encoded.select(
        "doc_id", "n_chars", "code", "n_words", "was_truncated",
        F.size("e").alias("n_encoded"),
        F.md5(decode(F.col("e"))).alias("decoded_md5"),
    )


@query
def tokenized_pairs(spark, sf_dir):
    pairs = batching.encode_pairs(line_pairs(spark, sf_dir).drop("doc_id"))
    return pairs.select(
        "pair_id", "input_truncated", "label_truncated",
        F.size("input_tokens").alias("n_input"),
        F.size("label_tokens").alias("n_label"),
        F.md5(F.array_join("input_tokens", " ")).alias("input_md5"),
        F.md5(F.array_join("label_tokens", " ")).alias("label_md5"),
    )


# --- batches -----------------------------------------------------------------


@query
def batches(spark, sf_dir):
    docs = splits.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return batching.with_batches(docs).select("doc_id", "split", "batch_id", "place")


def _encoded_corpus(spark, sf_dir):
    corpus = splits.exact_split(line_pairs(spark, sf_dir).drop("doc_id"))
    return batching.with_batches(batching.encode_pairs(corpus))


def _sized_corpus(spark, sf_dir, side):
    """Encoded pairs with the width of their batch on one side.

    Widths are found before the texts are encoded, so what moves is texts and not arrays of tokens.
    """
    corpus = batching.with_batches(splits.exact_split(line_pairs(spark, sf_dir).drop("doc_id")))
    return batching.encode_pairs(batching.with_width(corpus, batching.encoded_size(F.col(side))))


@query
def padded_batches(spark, sf_dir):
    rows = batching.pad(_sized_corpus(spark, sf_dir, "source"), "input_tokens")
    return rows.select(
        "pair_id", "split", "batch_id", "width",
        F.size("input_tokens").alias("n_tokens"),
        F.md5(F.array_join("padded", " ")).alias("padded_md5"),
    )


@query
def padding_waste(spark, sf_dir):
    """Padding of batches in rank order against batches by length."""
    rows = materialize(
        _encoded_corpus(spark, sf_dir).select("split", "rk", "batch_id", "input_tokens"), "encoded"
    )
    by_length = batching.length_batches(rows.drop("batch_id"), "input_tokens")
    in_order = batching.waste(rows, "input_tokens").withColumn("strategy", F.lit("in order"))
    return in_order.unionByName(
        batching.waste(by_length, "input_tokens").withColumn("strategy", F.lit("by length"))
    )


@query
def label_mask(spark, sf_dir):
    """Label ids padded with the ignored mark, and with it put back to the pad id."""
    rows = _sized_corpus(spark, sf_dir, "target").withColumn(
        "ids", batching.token_ids(F.col("label_tokens"))
    )
    # The mark is a number, so it is the ids that are padded.
    labels = rows.withColumn(
        "labels",
        F.concat("ids", F.array_repeat(F.lit(batching.IGNORED), F.col("width") - F.size("ids"))),
    )
    def total(values):
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    return labels.select(
        "pair_id", "split", "width",
        F.size(F.filter("labels", lambda x: x == batching.IGNORED)).alias("n_ignored"),
        total(F.col("labels")).alias("sum_masked"),
        total(batching.unmask(F.col("labels"), 1)).alias("sum_unmasked"),
    )


@query
def training_schedule(spark, sf_dir):
    """Intervals, step count and warm-up rate of every run."""
    n = F.col("data_size")
    return event_runs(spark, sf_dir).select(
        "run_seq", "data_size",
        eval_interval(n).alias("eval_steps"),
        save_interval(n).alias("save_steps"),
        total_steps(n, F.lit(8), F.lit(2), F.lit(3)).alias("max_steps"),
        F.round(warmup_rate(F.lit(5e-4), eval_interval(n)), 9).alias("rate_at_eval"),
    )


# --- metrics -----------------------------------------------------------------


@query
def corpus_bleu(spark, sf_dir):
    """BLEU of the source as prediction, all conversation pairs."""
    return metrics.corpus_bleu(_copy_predictions(conversation_pairs(spark, sf_dir)))


@query
def corpus_bleu_references(spark, sf_dir):
    """BLEU with two references per segment: the target and the source's own text."""
    pairs = conversation_pairs(spark, sf_dir)
    return metrics.corpus_bleu(
        pairs.select(
            "pair_id",
            F.col("target").alias("prediction"),
            F.array("source", F.concat_ws(" ", "source", "target")).alias("reference"),
        )
    )


@query
def corpus_chrf(spark, sf_dir):
    return metrics.corpus_chrf(_copy_predictions(conversation_pairs(spark, sf_dir)))


@query
def all_metrics(spark, sf_dir):
    """All line pairs, each line as the prediction of the next."""
    return metrics.all_metrics(_copy_predictions(line_pairs(spark, sf_dir)))


@query
def segment_scores(spark, sf_dir):
    return metrics.segment_scores(_copy_predictions(conversation_pairs(spark, sf_dir)))


def _length_band(text):
    n = word_count(text)
    return F.when(n < 10, "short").when(n < 40, "medium").otherwise("long")


@query
def metrics_by_slice(spark, sf_dir):
    """Scores by language, length band and document quality; the quality meets counts, not texts."""
    pairs = line_pairs(spark, sf_dir).withColumn("band", _length_band(F.col("target")))
    stats = metrics.segment_stats(
        _copy_predictions(pairs, "lang", "band", "doc_id"), ["lang", "band", "doc_id"]
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return metrics.corpus_scores(stats.join(labels, "doc_id", "left"), ["lang", "band", "quality"])


@query
def score_mean_std(spark, sf_dir):
    """Mean and deviation of a per-segment score."""
    scores = metrics.segment_scores(_copy_predictions(conversation_pairs(spark, sf_dir)))
    return metrics.score_mean_std(scores, "chrf")


@query
def masked_metrics(spark, sf_dir):
    """Labels padded with the ignored mark, unmasked, decoded and scored."""
    rows = batching.pad(
        _sized_corpus(spark, sf_dir, "target"), "label_tokens", str(batching.IGNORED)
    )
    decoded = rows.select(
        "split", "pair_id",
        decode(F.col("input_tokens")).alias("prediction"),
        decode(batching.unmask_tokens(F.col("padded"))).alias("reference"),
    )
    return metrics.all_metrics(decoded, ["split"], strip_text=False)


def _length_score():
    """A score of a segment that stands for a learnt one: how alike the two lengths are."""
    low, high = (f(F.length("prediction"), F.length("reference")) for f in (F.least, F.greatest))
    return F.when(high > 0, low / high).otherwise(1.0)


@query
def all_metrics_scored(spark, sf_dir):
    """All line pairs by language, with a per-segment score: how alike the lengths are."""
    copied = _copy_predictions(line_pairs(spark, sf_dir), "lang")
    return metrics.all_metrics(copied.withColumn("score", _length_score()), ["lang"], score="score")


@query
def mapped_batches(spark, sf_dir):
    """A user's batch function on documents: bytes and lines of each text."""

    def measured(batch):
        text = pc.fill_null(batch.column("text"), "")
        lines = pc.add(pc.count_substring(text, "\n"), 1)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), lines.cast(pa.int64())],
            ["doc_id", "n_bytes", "n_lines"],
        )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hooks.map_batches(docs, measured, "doc_id long, n_bytes long, n_lines long")


@query
def metric_hook(spark, sf_dir):
    """A user's metric per language beside chrF: exact matches, and bytes against the reference's."""

    def partial(batch):
        size = lambda c: pc.binary_length(batch.column(c)).cast(pa.float64())
        rows = pa.table(
            {
                "lang": batch.column("lang"),
                "same": pc.equal(batch.column("prediction"), batch.column("reference")).cast(pa.float64()),
                "said": size("prediction"), "wanted": size("reference"),
                "n": pa.array([1.0] * batch.num_rows),
            }
        )
        sums = rows.group_by("lang").aggregate([(c, "sum") for c in ("same", "said", "wanted", "n")])
        names = {"same_sum": "same", "said_sum": "said", "wanted_sum": "wanted", "n_sum": "n"}
        sums = sums.rename_columns([names.get(c, c) for c in sums.column_names])
        return sums.select(["lang", "same", "said", "wanted", "n"]).combine_chunks().to_batches()[0]

    ratios = {
        "exact": F.round(F.col("same") / F.col("n"), 9),
        "length_ratio": F.round(F.col("said") / F.col("wanted"), 9),
    }

    def length_metric(df, by):
        rows = df.select("lang", "prediction", "reference")
        return hooks.batch_metric(rows, by, partial, ["same", "said", "wanted", "n"], ratios)

    pairs = _copy_predictions(line_pairs(spark, sf_dir), "lang")
    return hooks.evaluate(pairs, [metrics.corpus_chrf, length_metric], ["lang"])


# --- run tables --------------------------------------------------------------


@query
def valid_runs(spark, sf_dir):
    return runs.valid_runs(event_runs(spark, sf_dir)).drop("failed")


@query
def near_best_runs(spark, sf_dir):
    return runs.near_best_runs(event_runs(spark, sf_dir)).select("run_seq", "data_size", "bleu")


@query
def best_size(spark, sf_dir):
    return runs.best_run(event_runs(spark, sf_dir)).select("run_seq", "data_size", "bleu")


@query
def recommended_size(spark, sf_dir):
    return runs.recommendation(event_runs(spark, sf_dir))


@query
def recommended_size_or_default(spark, sf_dir):
    """Per listed phase; a phase without runs takes the default."""
    return runs.phase_size_or_default(event_runs(spark, sf_dir), ["1", "2", "3", "4"])


@query
def best_config(spark, sf_dir):
    return runs.best_config(event_runs(spark, sf_dir))


@query
def run_csv(spark, sf_dir):
    """Valid runs written as CSV and read back under the run schema; absent columns are null."""
    path = fresh_path(spark, "runs-csv")
    write_run_csv(runs.valid_runs(event_runs(spark, sf_dir)).select("data_size", "bleu", "chrf", "loss"), path)
    return read_run_csv(spark, path)


@query
def stored_recommendation(spark, sf_dir):
    """Size and configuration written and read back, and the defaults where nothing was written."""
    every, root = event_runs(spark, sf_dir), fresh_path(spark, "stage")
    write_scalar(runs.recommendation(every).select("recommended_size"), f"{root}/size")
    write_document(runs.best_config(every).select("r", "alpha", "dropout"), f"{root}/config")
    out = None
    for label, folder in (("stored", root), ("absent", f"{root}/none")):
        size = read_size(spark, f"{folder}/size").select(F.col("value").alias("data_size"))
        row = size.crossJoin(read_config(spark, f"{folder}/config")).select(F.lit(label).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out  # each side of the product is one row


@query
def best_config_or_default(spark, sf_dir):
    """Configurations from JSON text; keys that are absent take their default."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    # The documents name the rank ``k``.
    document = F.regexp_replace("props", '"k":', '"r":')
    return events.select("event_id", parse_config(document).alias("c")).select("event_id", "c.*")


@query
def summary_rows(spark, sf_dir):
    return runs.summary_rows(event_runs(spark, sf_dir))


@query
def all_runs(spark, sf_dir):
    """Phase tables appended; the valid parts have no ``failed`` column."""
    every = event_runs(spark, sf_dir)
    columns = ["run_seq", "phase", "data_size", "bleu", "chrf", "loss"]
    parts = []
    for phase in runs.PHASE_GATES:
        part = every.where(F.col("phase") == phase)
        parts.append(runs.valid_runs(part).select(*columns))
        parts.append(part.where("failed").select(*columns, "failed"))
    return runs.all_runs(parts)


@query
def runs_with_sentinel(spark, sf_dir):
    """Every attempted run; those without scores as failed rows."""
    every = event_runs(spark, sf_dir)
    attempted = every.select("run_seq", "data_size")
    return runs.with_sentinel(attempted, runs.valid_runs(every))


@query
def phase_gate(spark, sf_dir):
    return runs.phase_gate(event_runs(spark, sf_dir))


@query
def gated_runs(spark, sf_dir):
    return runs.gated_runs(event_runs(spark, sf_dir)).select("run_seq", "phase", "bleu")


@query
def learning_curve(spark, sf_dir):
    return runs.learning_curve(event_runs(spark, sf_dir))


@query
def param_grid(spark, sf_dir):
    """All settings with the number of runs that tried them."""
    tried = event_runs(spark, sf_dir).groupBy("r", "alpha", "dropout").agg(
        F.count("*").alias("n_runs")
    )
    return runs.param_grid(spark).join(tried, ["r", "alpha", "dropout"], "left").select(
        "setting", "r", "alpha", "dropout", "folder", F.coalesce("n_runs", F.lit(0)).alias("n_runs")
    )


@query
def param_impact(spark, sf_dir):
    return runs.param_impact(event_runs(spark, sf_dir))


@query
def param_pivot(spark, sf_dir):
    return runs.param_pivot(event_runs(spark, sf_dir))


@query
def metric_log_long(spark, sf_dir):
    return runs.metric_log_long(event_runs(spark, sf_dir))


@query
def report_rows(spark, sf_dir):
    return runs.report_rows(event_runs(spark, sf_dir))


# --- metric logs -------------------------------------------------------------


@query
def logged_means(spark, sf_dir):
    return checkpoints.logged_means(checkpoints.numbered_log(event_log(spark, sf_dir)))


@query
def best_checkpoint(spark, sf_dir):
    numbered = checkpoints.numbered_log(event_log(spark, sf_dir))
    return checkpoints.best_checkpoints(checkpoints.logged_means(numbered))


@query
def early_stop_step(spark, sf_dir):
    return checkpoints.early_stops(event_log(spark, sf_dir))


@query
def running_best(spark, sf_dir):
    return checkpoints.running_best(event_log(spark, sf_dir)).select("event_id", "run", "best_so_far")


@query
def metric_windows(spark, sf_dir):
    return checkpoints.metric_windows(event_log(spark, sf_dir))


def _stream_paths(spark, name):
    root = fresh_path(spark, name)
    return f"{root}/out", f"{root}/state"


@query
def stream_metric_log(spark, sf_dir):
    """The log appended by a stream without repeats."""
    out, state = _stream_paths(spark, "stream-log")
    metric_log.append_log(event_log_stream(spark, sf_dir), out, state, delay=None).awaitTermination()
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def stream_metric_windows(spark, sf_dir):
    out, state = _stream_paths(spark, "stream-windows")
    metric_log.window_stream(event_log_stream(spark, sf_dir), out, state, delay=None).awaitTermination()
    windows = metric_log.read_windows(spark, out)
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_best_per_run(spark, sf_dir):
    out, state = _stream_paths(spark, "stream-best")
    metric_log.best_stream(event_log_stream(spark, sf_dir), out, state).awaitTermination()
    return metric_log.read_best(spark, out)


# --- predictors and sweeps ---------------------------------------------------


@query
def tm_predict(spark, sf_dir):
    corpus = line_corpus(spark, sf_dir)
    predicted = predict_from_memory(_train(corpus), corpus.where("split = 'test'"))
    return predicted.select("pair_id", "match_rk", F.round("similarity", 9).alias("similarity"), "prediction")


@query
def tm_predict_any(spark, sf_dir):
    """The same with the number of test lines that share no word with any source."""
    corpus = line_corpus(spark, sf_dir)
    predicted = predict_from_memory(_train(corpus), corpus.where("split = 'test'"))
    return predicted.select(
        "pair_id", "match_rk", F.round("similarity", 9).alias("similarity"), "prediction", "n_unmatched"
    )


@query
def lexical_table(spark, sf_dir):
    pairs = splits.hash_split(conversation_pairs(spark, sf_dir), "pair_id")
    learned = lexicon.lexical_table(_train(pairs))
    return learned.select("s", "t", "n_pairs", F.round("prob", 9).alias("prob"))


@query
def lexical_predict(spark, sf_dir):
    pairs = materialize(splits.hash_split(conversation_pairs(spark, sf_dir), "pair_id"), "pairs")
    learned = lexicon.lexical_table(_train(pairs))
    predicted = lexicon.lexical_predict(learned, pairs.where("split = 'test'"))
    return predicted.select("pair_id", "prediction")


def _sweep(spark, sf_dir, corpus=None):
    corpus = sweep_corpus(spark, sf_dir) if corpus is None else corpus
    train = _train(corpus)
    sizes = sweeps.sweep_sizes(train.count())  # whole, or as many rows as the largest size asks for
    return sweeps.scaling_sweep(train, corpus.where("split = 'val'"), sizes)


@query
def scaling_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query
def scaling_sweep_any(spark, sf_dir):
    """The size sweep under its earlier name; the sweep itself has no floor any more."""
    return _sweep(spark, sf_dir)


def _phase_of(seq):
    """The phase that a place in the list of sizes belongs to; the capped size is in the last."""
    if seq > len(sweeps.DATA_SIZES):
        return list(PHASE_SIZES)[-1]
    return next(name for name, sizes in PHASE_SIZES.items() if sweeps.DATA_SIZES[seq - 1] in sizes)


def _phased(spark, sf_dir, gates):
    places = range(1, len(sweeps.DATA_SIZES) + 2)
    phase = F.element_at(F.array(*[F.lit(_phase_of(i)) for i in places]), F.col("run_seq").cast("int"))
    swept = materialize(
        _sweep(spark, sf_dir).select("*", phase.alias("phase"), F.lit(None).cast("boolean").alias("failed")),
        "swept",
    )
    return runs.gated_runs(swept, gates).select("run_seq", "phase", "data_size", "bleu", "chrf")


@query
def phased_sweep(spark, sf_dir):
    """Sweep rows of the phases that the reference's gate reaches."""
    return _phased(spark, sf_dir, runs.PHASE_GATES)


@query
def phased_sweep_passed(spark, sf_dir):
    """The same under a lower gate, which lets the later phases run."""
    return _phased(spark, sf_dir, LOWER_GATES)


@query
def phased_sweep_stopped(spark, sf_dir):
    """The phases that a gate stops, decided lazily: what lies behind a closed gate never runs."""
    corpus = sweep_corpus(spark, sf_dir)
    train = _train(corpus)
    sizes = sweeps.sweep_sizes(train.count())
    listed = {
        name: [(seq, size) for seq, size in sizes if _phase_of(seq) == name] for name in PHASE_SIZES
    }
    swept = sweeps.phased_sweep(train, corpus.where("split = 'val'"), listed, runs.PHASE_GATES)
    return swept.select("run_seq", "phase", "data_size", "bleu", "chrf")


@query
def summary_document(spark, sf_dir):
    """Recommendation of the size sweep with its runs nested in order."""
    swept = materialize(_sweep(spark, sf_dir).withColumn("failed", F.lit(None).cast("boolean")), "swept")
    document = runs.summary_document(swept, max_runs=len(sweeps.DATA_SIZES) + 1)
    line = F.transform(
        "all_results",
        lambda r: F.format_string("%d %.9f %.9f %.9f", r["data_size"], r["bleu"], r["chrf"], r["loss"]),
    )
    return document.select(
        "optimal_size", "recommended_size", F.array_join(line, "\n").alias("all_results")
    )


@query
def param_sweep(spark, sf_dir):
    corpus = line_corpus(spark, sf_dir)
    return sweeps.param_sweep(_train(corpus), corpus.where("split = 'val'"))


@query
def test_evaluation(spark, sf_dir):
    corpus = line_corpus(spark, sf_dir)
    predicted = materialize(sweeps.evaluate_splits(corpus, ["test"]), "test-predictions")
    return sweeps.scores_by_split(predicted)


@query
def sample_predictions(spark, sf_dir):
    corpus = line_corpus(spark, sf_dir)
    return sweeps.samples(sweeps.evaluate_splits(corpus, ["test"]))


@query
def baseline_comparison(spark, sf_dir):
    """Copying the source against the translation memory, on the test split."""
    corpus = line_corpus(spark, sf_dir)
    test = corpus.where("split = 'test'")
    remembered = sweeps.evaluate_splits(corpus, ["test"]).select(
        "pair_id", "prediction", F.col("target").alias("reference")
    )
    both = _copy_predictions(test).withColumn("system", F.lit("copy")).unionByName(
        remembered.withColumn("system", F.lit("memory"))
    )
    names = ["bleu", "chrf", "score_mean"]
    rated = metrics.all_metrics(both.withColumn("score", _length_score()), ["system"], score="score")
    scores = materialize(rated.unpivot(["system"], names, "metric", "value"), "scores")
    listed = spark.createDataFrame([(n,) for n in names], "metric string")
    return runs.compare_scores(
        listed, scores.where("system = 'copy'"), scores.where("system = 'memory'")
    )


@query
def final_result(spark, sf_dir):
    """Size of the size sweep and setting of the grid, used in the search; scores and samples."""
    corpus = line_corpus(spark, sf_dir)
    swept = _sweep(spark, sf_dir, corpus)
    grid = sweeps.param_sweep(_train(corpus), corpus.where("split = 'val'"))
    result = sweeps.final_result(corpus, sweeps.plan_state(materialize(swept, "swept"), materialize(grid, "grid")))
    return result.select(
        "validation_bleu", "validation_chrf", "test_bleu", "test_chrf",
        "configuration.gram_order", "configuration.beta", "configuration.min_similarity", "data_size",
        F.array_join("sample_predictions", "\n--\n").alias("sample_predictions"),
        F.array_join("sample_references", "\n--\n").alias("sample_references"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation-memory predictions for the test split, scored with all metrics."""
    return test_evaluation(spark, sf_dir)
