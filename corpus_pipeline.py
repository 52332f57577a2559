"""A pipeline over documents, stage by stage, each stage one operator.

Quality classifier, quality rules, near-duplicates, mixing, packing. A stage
gets all that its predecessor kept and its decisions take effect: rejected
documents go, one document of each group of near-duplicates stays, documents
are repeated or cut as the mix says, and the last stage returns token pieces
with their places in sequences.

Every stage takes (spark, docs, sf_dir). All but the last return exactly the
columns of ``docs``; nulls, empty tables, repeated rows and further columns have
the results that the operators' own descriptions state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import line_rules, mixing, near_duplicates, packing, quality_model
from loomwork.session import prepare, read_table, stored

#: The least quality score that a document needs, as in the query op10_quality.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below LEAST_QUALITY."""
    prepare(spark)
    scored = quality_model.with_scores(docs, read_table(spark, sf_dir, "labels"), score="__score")
    return scored.filter(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are mostly lines common in their source."""
    prepare(spark)
    return line_rules.kept_rows(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    prepare(spark)
    return near_duplicates.first_of_each(docs).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or cuts documents so that each source has its target of words."""
    prepare(spark)
    return mixing.emit(docs, mixing.draw(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024; the only stage with other columns."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicate_removal),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]

#: The classifier's fit, the signatures and the tokenizer have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next stage."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
