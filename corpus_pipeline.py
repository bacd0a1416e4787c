"""A corpus from documents: toxic ones go, repeated lines go, one of each group of near copies stays, benchmark leaks go, sources are mixed.

Each stage takes documents with any further columns, whatever their names, and all but the last return the columns as
they came. Rows whose doc_id is null or repeats are judged one by one; null and empty texts are empty documents; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm.common import Scratch
from orefield.llm.decontamination import without_contaminated
from orefield.llm.line_dedup import without_repeated_lines
from orefield.llm.mixing import repeated
from orefield.llm.simhash import without_near_copies
from orefield.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, nulls and empty ones among them; the model learns from the labelled ones among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return without_toxic(docs, fit(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its repeated lines; n_chars follows the text where lines went, else both stay as they are."""
    out, changed = without_repeated_lines(docs)
    return out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (null last); documents without words are one group."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy (column copy, copy_ where there is one)."""
    return repeated(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: A trained classifier and sketches are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
