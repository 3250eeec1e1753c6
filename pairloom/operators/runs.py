"""Analytics over run tables.

A run table may be as large as a metric log: every operator here is a filter, an
aggregate with partial sums, or a top-1 by aggregate. Only tables bounded by a
given list (phases, sizes, parameter values) are ordered or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.sources.runs import (
    ALPHAS,
    DEFAULT_CONFIG,
    DEFAULT_SIZE,
    DROPOUTS,
    FAILED_LOSS,
    FAILED_SCORE,
    RANKS,
    SMALLEST_SIZE,
)

NEAR_BEST = 0.95
# Fixed value: folder of a grid run, by rank, alpha and dropout.
RUN_FOLDER = "experiments/param_r%d_a%d_d%s"
# Lowest best score with which a phase lets the next one start.
PHASE_GATES = {"1": 0.15, "2": None, "3": None}
DIGITS = 9


def valid_runs(runs: DataFrame) -> DataFrame:
    return runs.where(~F.coalesce("failed", F.lit(False)))


def near_best_runs(runs: DataFrame, share: float = NEAR_BEST) -> DataFrame:
    valid = valid_runs(runs)
    best = valid.agg(F.max("bleu")).scalar()
    return valid.where(F.col("bleu") >= best * F.lit(share))


def best_run(runs: DataFrame) -> DataFrame:
    """The first valid run with the highest score; no row if none is valid."""
    return valid_runs(runs).orderBy(F.desc("bleu"), "run_seq").limit(1)


def best_config(runs: DataFrame) -> DataFrame:
    """Grid point of the best run, or the default where no run scored."""
    order = F.struct("bleu", -F.col("run_seq"))
    best = valid_runs(runs).agg(
        F.max_by(F.struct("r", "alpha", "dropout", "bleu"), order).alias("b")
    )
    scored = F.coalesce(F.col("b.bleu") > 0, F.lit(False))
    return best.select(
        *[
            F.when(scored, F.col(f"b.{k}")).otherwise(F.lit(v)).alias(k)
            for k, v in DEFAULT_CONFIG.items()
        ],
        F.when(scored, F.col("b.bleu")).otherwise(F.lit(0.0)).alias("bleu"),
    )


def recommendation(runs: DataFrame, share: float = NEAR_BEST) -> DataFrame:
    """One row: size of the best run and smallest size that scores near it.

    One scan: each size keeps its best score and the first run that has it, which is enough for
    both answers; the second step sees one row per size.
    """
    first = F.struct("bleu", (-F.col("run_seq")).alias("back"))
    per_size = valid_runs(runs).groupBy("data_size").agg(F.max(first).alias("top"))
    ranked = per_size.withColumn("best", F.max("top.bleu").over(Window.partitionBy(F.lit(1))))
    found = ranked.agg(
        F.max("best").alias("best"),
        F.max_by("data_size", "top").alias("optimal"),
        F.min(F.when(F.col("top.bleu") >= F.col("best") * F.lit(share), F.col("data_size"))).alias("near"),
    )
    scored = F.coalesce(F.col("best") > 0, F.lit(False))
    return found.select(
        F.when(scored, F.col("optimal")).otherwise(SMALLEST_SIZE).cast("long").alias("optimal_size"),
        F.when(scored, F.col("near")).otherwise(SMALLEST_SIZE).cast("long").alias("recommended_size"),
    )


def summary_document(runs: DataFrame, max_runs: int) -> DataFrame:
    """Recommendation with all runs nested in their order.

    Meant for the runs of one sweep, whose number is the length of a given list
    (``max_runs``); a longer table raises instead of filling one row. For large
    run tables use ``summary_rows``.
    """
    fields = [c for c in ("data_size", "bleu", "chrf", "loss", "failed") if c in runs.columns]
    n = runs.agg(F.count("*")).scalar()
    checked = runs.where(
        F.when(n > max_runs, F.raise_error(F.lit("too many runs for one document"))).otherwise(True)
    )
    listed = checked.agg(
        F.sort_array(F.collect_list(F.struct("run_seq", F.struct(*fields).alias("run")))).alias("all")
    )
    rec = recommendation(checked)
    return rec.select("*", listed.scalar().alias("all")).select(
        "optimal_size", "recommended_size", F.col("all.run").alias("all_results")
    )


def summary_rows(runs: DataFrame) -> DataFrame:
    """The recommendation beside every run, one row per run."""
    fields = ["optimal_size", "recommended_size"]
    rec = recommendation(runs).select(F.struct(*fields).alias("rec"))
    columns = ["run_seq", "data_size", "bleu", "chrf", "loss", "failed"]
    return runs.select(*columns, rec.scalar().alias("rec")).select(*columns, *[f"rec.{f}" for f in fields])


def all_runs(parts: list[DataFrame]) -> DataFrame:
    """Append phase results; a part without ``failed`` has no failed run."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _phases(spark: SparkSession, gates: dict) -> DataFrame:
    return spark.createDataFrame(list(gates.items()), "phase string, least_bleu double")


def phase_gate(runs: DataFrame, gates: dict = PHASE_GATES) -> DataFrame:
    """Attempted, failed and valid runs per listed phase, and whether to go on."""
    failed = F.coalesce("failed", F.lit(False))
    counted = runs.groupBy("phase").agg(
        F.count("*").alias("attempted"),
        F.count_if(failed).alias("failed_runs"),
        F.count_if(~failed).alias("valid_runs"),
        F.max(F.when(~failed, F.col("bleu"))).alias("best_bleu"),
    )
    goes_on = (F.col("valid_runs") > 0) & (
        F.col("least_bleu").isNull() | (F.col("best_bleu") >= F.col("least_bleu"))
    )
    return (
        _phases(runs.sparkSession, gates)
        .join(counted, "phase", "left")
        .na.fill(0, ["attempted", "failed_runs", "valid_runs"])
        .select("phase", "attempted", "failed_runs", "valid_runs", "best_bleu",
                F.coalesce(goes_on, F.lit(False)).alias("goes_on"))
    )


def gated_runs(runs: DataFrame, gates: dict = PHASE_GATES) -> DataFrame:
    """Runs of the phases whose predecessors, in the order of ``gates``, let the sweep go on."""
    place = F.array_position(F.array(*map(F.lit, gates)), F.col("phase"))
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        phase_gate(runs, gates)
        .select("phase", F.coalesce(F.bool_and("goes_on").over(before), F.lit(True)).alias("reached"))
        .where("reached")
        .select("phase")
    )
    # One row per listed phase, so the broadcast side has a fixed size.
    return runs.join(F.broadcast(reached), "phase", "left_semi")


def learning_curve(runs: DataFrame) -> DataFrame:
    """Best score per size and the gain over the next smaller size.

    Runs are aggregated first; the window sees one row per size.
    """
    per_size = valid_runs(runs).groupBy("data_size").agg(
        F.count("*").alias("n_runs"), F.max("bleu").alias("bleu"), F.max("chrf").alias("chrf")
    )
    by_size = Window.orderBy("data_size")
    return per_size.select(
        "*",
        F.round(F.col("bleu") - F.lag("bleu").over(by_size), DIGITS).alias("bleu_gain"),
        F.round(F.col("chrf") - F.lag("chrf").over(by_size), DIGITS).alias("chrf_gain"),
    )


def param_impact(runs: DataFrame) -> DataFrame:
    """Mean score per value of each parameter, in one pass over the runs."""
    params = ("r", "alpha", "dropout")
    valid = valid_runs(runs).select(*params, "bleu").dropna(subset=list(params))
    sets = valid.groupingSets([[F.col(p)] for p in params], *[F.col(p) for p in params]).agg(
        F.avg("bleu").alias("mean"), F.count("*").alias("n_runs"),
        *[F.grouping(p).alias(f"_{p}") for p in params],
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for p in params:
        name = F.when(F.col(f"_{p}") == 0, p).otherwise(name)
        value = F.when(F.col(f"_{p}") == 0, F.col(p).cast("double")).otherwise(value)
    return sets.select(
        name.alias("parameter"), value.alias("value"), "n_runs",
        F.round("mean", DIGITS).alias("mean_bleu"),
    )


def param_pivot(runs: DataFrame, alphas=ALPHAS) -> DataFrame:
    """Mean score by rank (rows) and alpha (columns)."""
    wide = valid_runs(runs).groupBy("r").pivot("alpha", list(alphas)).agg(F.avg("bleu"))
    return wide.select("r", *[F.round(F.col(f"`{a}`"), DIGITS).alias(f"alpha_{a}") for a in alphas])


def param_grid(spark: SparkSession, ranks=RANKS, alphas=ALPHAS, dropouts=DROPOUTS) -> DataFrame:
    """All settings in order with their run folder; one row is expanded in place."""
    def options(values):
        return F.explode(F.array(*[F.lit(v) for v in values]))

    seq = (
        F.array_position(F.array(*[F.lit(v) for v in ranks]), F.col("r")) - 1
    ) * (len(alphas) * len(dropouts)) + (
        F.array_position(F.array(*[F.lit(v) for v in alphas]), F.col("alpha")) - 1
    ) * len(dropouts) + F.array_position(F.array(*[F.lit(v) for v in dropouts]), F.col("dropout"))
    return (
        spark.range(1)
        .select(options(ranks).alias("r"))
        .select("r", options(alphas).alias("alpha"))
        .select("r", "alpha", options(dropouts).alias("dropout"))
        .select(
            seq.alias("setting"), "r", "alpha", "dropout",
            F.format_string(RUN_FOLDER, "r", "alpha", F.col("dropout").cast("string")).alias("folder"),
        )
    )


def metric_log_long(runs: DataFrame) -> DataFrame:
    """One row per run and metric."""
    return runs.select(F.col("run_seq").alias("run_id"), F.col("data_size").alias("step"),
                       "bleu", "chrf", "loss").unpivot(
        ["run_id", "step"], ["bleu", "chrf", "loss"], "metric", "value"
    )


def with_sentinel(attempted: DataFrame, scores: DataFrame) -> DataFrame:
    """Every attempted run; one without scores becomes a failed row."""
    joined = attempted.join(
        scores.select("run_seq", "bleu", "chrf", "loss", F.lit(True).alias("_scored")),
        "run_seq", "left",
    )
    return joined.select(
        *attempted.columns,
        F.coalesce("bleu", F.lit(FAILED_SCORE)).alias("bleu"),
        F.coalesce("chrf", F.lit(FAILED_SCORE)).alias("chrf"),
        F.coalesce("loss", F.lit(FAILED_LOSS)).alias("loss"),
        F.when(F.col("_scored").isNull(), True).alias("failed"),
    )


def size_or_default(sizes: DataFrame, default: int = DEFAULT_SIZE) -> DataFrame:
    """The stored recommendation, or the default when the table is empty."""
    return sizes.agg(F.coalesce(F.max("recommended_size"), F.lit(default)).alias("data_size"))


def phase_size_or_default(runs: DataFrame, phases: list[str], default: int = DEFAULT_SIZE) -> DataFrame:
    """Smallest near-best size of every listed phase, or the default."""
    valid = valid_runs(runs)
    per_size = valid.groupBy("phase", "data_size").agg(F.max("bleu").alias("bleu"))
    best = per_size.groupBy("phase").agg(F.max("bleu").alias("best"))
    near = (
        per_size.join(best, "phase")
        .where(F.col("bleu") >= F.col("best") * F.lit(NEAR_BEST))
        .groupBy("phase")
        .agg(F.min("data_size").alias("found"))
    )
    listed = runs.sparkSession.createDataFrame([(p,) for p in phases], "phase string")
    return listed.join(near, "phase", "left").select(
        "phase", F.coalesce("found", F.lit(default).cast("long")).alias("data_size")
    )


def compare_scores(metrics: DataFrame, baseline: DataFrame, final: DataFrame) -> DataFrame:
    """Baseline and final value per listed metric, a missing one as 0, and the gain.

    All three are long tables of one row per metric name.
    """
    return (
        metrics.join(baseline.select("metric", F.col("value").alias("b")), "metric", "left")
        .join(final.select("metric", F.col("value").alias("f")), "metric", "left")
        .select(
            F.upper("metric").alias("label"),
            F.coalesce("b", F.lit(0.0)).alias("baseline"),
            F.coalesce("f", F.lit(0.0)).alias("final"),
        )
        .withColumn("gain", F.round(F.col("final") - F.col("baseline"), DIGITS))
    )


def report_rows(runs: DataFrame) -> DataFrame:
    """Runs as text for a report: whole numbers, four decimals, upper-case labels."""
    return runs.select(
        "run_seq",
        F.upper(F.concat(F.lit("phase "), F.col("phase"))).alias("label"),
        F.col("data_size").cast("string").alias("size_text"),
        F.format_string("%.4f", "bleu").alias("bleu_text"),
        F.format_string("%.4f", "chrf").alias("chrf_text"),
    )
