"""From raw documents to a training mix, in five stages, each written before the next reads it.

Every stage takes the documents that its predecessor kept, decides on all of them, and returns
the columns of documents (extra columns of the input, whatever their names, are left out); the
last returns the mix. Null ids, null or empty texts, repeated rows and empty tables pass through
every stage by the rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.decontaminate import without_benchmark
from pairloom.llm.minhash import one_of_each
from pairloom.llm.mixing import plan_mix, taken_words
from pairloom.llm.pii import find_pii, redacted
from pairloom.llm.quality import score_documents, train_classifier
from pairloom.session import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    model = train_classifier(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    scored = score_documents(docs, model, threshold=0.3, keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id."""
    return one_of_each(docs, least=0.8, columns=COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage similar to a benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"), least=0.8, columns=COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    found = find_pii(docs, keep=COLUMNS)
    clean = found.withColumn("_clean", redacted(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    return clean.select(
        "doc_id",
        F.col("_clean").alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words it takes of each, repeats counted."""
    return taken_words(plan_mix(docs)).where("taken > 0")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("PII", without_pii),
    ("mixing sources to target weights", mixed),
]

# Trained scores and hashed orders have no form in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
