"""From raw documents to packed training windows, in five stages.

Each stage is a function of (spark, docs, sf_dir).  All but the last return the
columns of ``documents``; each stage's rows are written and read again before the
next.  Rows that share an id are told apart by their texts, but for benchmark
passages: there they stand or fall together, and a null id is never dropped.
Empty tables give empty results; null and empty texts fail the quality rules.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from tideline.llm.common import folders, release, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that stages have made for themselves.
_own: set[str] = set()


def _stage(function: Stage) -> Stage:
    """Deletes, as it starts, what earlier stages stored for themselves, but for what its own input still reads."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _own, keep=docs)
        before = folders(spark)
        out = function(spark, docs, sf_dir)
        _own.update(folders(spark) - before)
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule of the current policy."""
    ledger = quality_rules.evaluate(docs.select(*COLUMNS))
    return ledger.where(quality_rules.passes(quality_rules.V1)).select(*COLUMNS)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that at least ten documents hold."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (a null one first) of each group of near duplicates; one of rows with equal id and text."""
    row = F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row")
    rows = docs.select(*COLUMNS, row)
    grouped, _ = ngram_join.near_duplicates(rows.select("row", "text"), key="row")
    grouped = stored(grouped.where("n_shingles > 0").select("row", "component_id"), "groups")
    extra = grouped.where("not row <=> component_id").select("row").distinct()
    twice = grouped.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row")
    kept = rows.join(extra, "row", "left_anti")
    once = kept.join(twice, "row", "left_semi").dropDuplicates(["row"])
    return kept.join(twice, "row", "left_anti").unionByName(once).select(*COLUMNS)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and the windows that they are packed into."""
    release(spark, _own, keep=docs)
    return packing.op8_packing(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: Hashing, verification of shingles and byte-pair encoding have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
