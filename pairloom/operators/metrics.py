"""Corpus BLEU and chrF, per segment, per slice and per evaluation.

One plan serves all of them. N-grams are matched inside the task that reads the
text, so texts do not move: one small row of integers per segment leaves the
task, and corpus scores are sums of those. Slices and settings can be joined to
these rows afterwards (``segment_stats``, then ``corpus_scores``). With several
references per segment texts are spread by segment id and n-grams become rows,
grouped by keys that contain the segment id and so without another shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairloom.functions.text import strip, text_or_empty, tokens_13a
from pairloom.operators.ngrams import stats_batches

WORD_ORDERS = 4  # BLEU n-grams
CHAR_ORDERS = 6  # chrF n-grams
BETA = 2.0  # chrF weight of recall
DIGITS = 9  # scores are rounded, as the order of summation is free

BLEU_COLUMNS = ("bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4")
METRICS = (*BLEU_COLUMNS, "chrf")

def _total(length: Column, n: int) -> Column:
    """Number of n-grams in a sequence of that length."""
    return F.greatest(length - (n - 1), F.lit(0))


def _texts(df: DataFrame, by: list[str], strip_text: bool) -> DataFrame:
    """The keys and the cleaned texts of every segment."""
    clean = strip if strip_text else (lambda c: c)
    if _several(df):
        refs = F.transform("reference", lambda r: clean(text_or_empty(r)))
    else:
        refs = clean(text_or_empty(F.col("reference")))
    return df.select(
        *by,
        "pair_id",
        clean(text_or_empty(F.col("prediction"))).alias("prediction"),
        refs.alias("reference"),
    )


def _several(df: DataFrame) -> bool:
    """Whether ``reference`` is an array of texts."""
    return dict(df.dtypes)["reference"].startswith("array")


def _unit_rows_several(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Word rows: side 0 is the prediction, references are numbered from 1."""
    both = F.concat(F.array("prediction"), F.col("reference"))
    return texts.select(*keys, F.posexplode(both).alias("side", "text")).select(
        *keys, "side", tokens_13a(F.col("text")).alias("units")
    )


def _gram_rows(units: DataFrame, keys: list[str]) -> DataFrame:
    """All word n-grams of every row; the outer form keeps empty texts."""
    size = F.size("units")
    starts = units.select(
        "*",
        F.explode_outer(F.when(size > 0, F.sequence(F.lit(1), size))).alias("at"),
    )
    spans = starts.select(
        "*",
        F.explode_outer(
            F.when(
                F.col("at").isNotNull(),
                F.sequence(F.lit(1), F.least(F.lit(WORD_ORDERS), size - F.col("at") + 1)),
            )
        ).alias("n"),
    )
    return spans.select(
        *keys, "side", "n", F.array_join(F.slice("units", F.col("at"), F.col("n")), " ").alias("gram")
    )


def _stats_single(texts: DataFrame, keys: list[str], words: bool, chars: bool) -> DataFrame:
    sides = [("word", WORD_ORDERS)] * words + [("char", CHAR_ORDERS)] * chars
    rows = texts.select(*keys, "prediction", "reference")
    schema = T.StructType([rows.schema[k] for k in keys])
    for name, orders in sides:
        for c in (f"pred_{name}s", f"ref_{name}s", *(f"{name}_match_{n + 1}" for n in range(orders))):
            schema = schema.add(c, T.LongType())
    return rows.mapInArrow(lambda batches: stats_batches(batches, keys, sides), schema)


def _stats_several(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Word statistics against the best count over all references of a segment."""
    texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id")
    shortest = F.array_min(F.transform("reference", lambda t: F.size(tokens_13a(t))))
    keys = [*keys, "shortest"]
    side, n = F.col("side"), F.col("n")
    per_side = (
        _gram_rows(_unit_rows_several(texts.withColumn("shortest", shortest), keys), keys)
        .groupBy(*keys, "n", "gram", "side")
        .agg(F.count("gram").alias("k"))
    )
    counted = per_side.groupBy(*keys, "n", "gram").agg(
        F.sum(F.when(side == 0, F.col("k")).otherwise(0)).alias("p"),
        F.max(F.when(side > 0, F.col("k")).otherwise(0)).alias("r"),
    )
    return (
        counted.groupBy(*keys)
        .agg(
            F.sum(F.when(n == 1, F.col("p")).otherwise(0)).alias("pred_words"),
            *[
                F.sum(F.when(n == i, F.least("p", "r")).otherwise(0)).alias(f"word_match_{i}")
                for i in range(1, WORD_ORDERS + 1)
            ],
        )
        .withColumn("ref_words", F.col("shortest").cast("long"))
        .drop("shortest")
    )


def segment_stats(
    df: DataFrame,
    by: list[str] | None = None,
    words: bool = True,
    chars: bool = True,
    strip_text: bool = True,
) -> DataFrame:
    """Integer n-gram statistics, one row per segment and evaluation.

    ``df`` has ``pair_id`` (unique per evaluation), ``prediction``, ``reference``
    (a text, or for BLEU an array of texts) and the columns named in ``by``.
    """
    by = list(by or [])
    several = _several(df)
    if chars and several:
        raise ValueError("chrF takes one reference per segment")
    texts = _texts(df, by, strip_text)
    keys = [*by, "pair_id"]
    stats = (
        _stats_several(texts, keys) if several else _stats_single(texts, keys, words, chars)
    )
    for name, wanted, orders in (("word", words, WORD_ORDERS), ("char", chars, CHAR_ORDERS)):
        if not wanted:
            absent = [f"pred_{name}s", f"ref_{name}s"]
            absent += [f"{name}_match_{n}" for n in range(1, orders + 1)]
            stats = stats.withColumns({c: F.lit(0).cast("long") for c in absent})
    return stats


def totals(stats: DataFrame, by: list[str] | None = None, score: str | None = None) -> DataFrame:
    """Corpus sums of segment statistics, and mean and deviation of a column ``score``."""
    c, r = F.col("pred_chars"), F.col("ref_chars")
    sums = [
        F.count("*").alias("n_segments"),
        F.sum("pred_words").alias("pred_words"),
        F.sum("ref_words").alias("ref_words"),
    ]
    for n in range(1, WORD_ORDERS + 1):
        sums.append(F.sum(f"word_match_{n}").alias(f"word_match_{n}"))
        sums.append(F.sum(_total(F.col("pred_words"), n)).alias(f"word_total_{n}"))
    for n in range(1, CHAR_ORDERS + 1):
        sums.append(F.sum(f"char_match_{n}").alias(f"char_match_{n}"))
        # A prediction's n-grams count only where the reference has some.
        sums.append(F.sum(F.when(r >= n, _total(c, n)).otherwise(0)).alias(f"char_pred_{n}"))
        sums.append(F.sum(_total(r, n)).alias(f"char_ref_{n}"))
    if score:
        sums += [
            F.round(F.coalesce(F.avg(score), F.lit(0.0)), DIGITS).alias("score_mean"),
            F.round(F.coalesce(F.stddev_pop(score), F.lit(0.0)), DIGITS).alias("score_std"),
        ]
    return stats.groupBy(*(by or [])).agg(*sums)


def with_segment_totals(stats: DataFrame) -> DataFrame:
    """The columns of ``totals`` for each segment on its own."""
    c, r = F.col("pred_chars"), F.col("ref_chars")
    return stats.select(
        "*",
        *[_total(F.col("pred_words"), n).alias(f"word_total_{n}") for n in range(1, WORD_ORDERS + 1)],
        *[
            F.when(r >= n, _total(c, n)).otherwise(0).alias(f"char_pred_{n}")
            for n in range(1, CHAR_ORDERS + 1)
        ],
        *[_total(r, n).alias(f"char_ref_{n}") for n in range(1, CHAR_ORDERS + 1)],
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def bleu_columns() -> list[Column]:
    """BLEU in 0..1 and its n-gram precisions from summed statistics."""
    orders = range(1, WORD_ORDERS + 1)
    precisions = [_ratio(F.col(f"word_match_{n}"), F.col(f"word_total_{n}")) for n in orders]
    mean_log = reduce(add, [F.ln(p) for p in precisions]) / WORD_ORDERS
    c, r = F.col("pred_words"), F.col("ref_words")
    brevity = F.when(c > r, 1.0).otherwise(F.exp(1 - r / c))
    bleu = F.when(F.least(*precisions) > 0, brevity * F.exp(mean_log)).otherwise(0.0)
    return [
        F.round(bleu, DIGITS).alias("bleu"),
        *[F.round(p, DIGITS).alias(f"bleu_{n}") for n, p in zip(orders, precisions)],
    ]


def chrf_column() -> Column:
    """chrF in 0..100 from summed statistics."""
    orders = range(1, CHAR_ORDERS + 1)
    match = {n: F.col(f"char_match_{n}") for n in orders}
    pred = {n: F.col(f"char_pred_{n}") for n in orders}
    ref = {n: F.col(f"char_ref_{n}") for n in orders}
    counts = {n: (pred[n] > 0) & (ref[n] > 0) for n in orders}
    effective = reduce(add, [F.when(counts[n], 1).otherwise(0) for n in orders])

    def mean(of: dict[int, Column]) -> Column:
        total = reduce(add, [F.when(counts[n], match[n] / of[n]).otherwise(0.0) for n in orders])
        return F.when(effective > 0, total / effective).otherwise(0.0)

    p, r = mean(pred), mean(ref)
    weight = BETA * BETA
    score = F.when(p + r > 0, 100 * ((1 + weight) * p * r / (weight * p + r))).otherwise(0.0)
    return F.round(score, DIGITS).alias("chrf")


def corpus_scores(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """BLEU with precisions and chrF from segment statistics."""
    by = list(by or [])
    return totals(stats, by).select(*by, "n_segments", *bleu_columns(), chrf_column())


def corpus_bleu(df: DataFrame, by: list[str] | None = None, strip_text: bool = True) -> DataFrame:
    by = list(by or [])
    stats = segment_stats(df, by, chars=False, strip_text=strip_text)
    return totals(stats, by).select(*by, "n_segments", *bleu_columns())


def corpus_chrf(df: DataFrame, by: list[str] | None = None, strip_text: bool = True) -> DataFrame:
    by = list(by or [])
    stats = segment_stats(df, by, words=False, strip_text=strip_text)
    return totals(stats, by).select(*by, "n_segments", chrf_column())


def all_metrics(
    df: DataFrame, by: list[str] | None = None, strip_text: bool = True, score: str | None = None
) -> DataFrame:
    """BLEU with precisions and chrF in one pass over the texts.

    ``score`` names a column with a score of each segment, made elsewhere; its mean and population
    deviation come along.
    """
    by = list(by or [])
    stats = segment_stats(df, [*by, *([score] if score else [])], strip_text=strip_text)
    found = totals(stats, by, score)
    extra = ["score_mean", "score_std"] if score else []
    return found.select(*by, "n_segments", *bleu_columns(), chrf_column(), *extra)


def segment_scores(df: DataFrame, by: list[str] | None = None, strip_text: bool = True) -> DataFrame:
    by = list(by or [])
    stats = with_segment_totals(segment_stats(df, by, strip_text=strip_text))
    return stats.select(*by, "pair_id", *bleu_columns(), chrf_column())


def score_mean_std(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of a per-segment model score.

    No scores give 0.0 for both.
    """
    return df.groupBy(*(by or [])).agg(
        F.round(F.coalesce(F.avg(score), F.lit(0.0)), DIGITS).alias("score_mean"),
        F.round(F.coalesce(F.stddev_pop(score), F.lit(0.0)), DIGITS).alias("score_std"),
    )
