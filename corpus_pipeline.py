"""A corpus pipeline of five of the operators; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylomill.llm import decontaminate, line_dedup, near_dedup, quality_rules, sentencepieces
from phylomill.llm.repeats import without
from phylomill.stash import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rejected rows go, each by its own text, language and source; a null doc_id plays no part."""
    return quality_rules.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: blocks of lines that an earlier document has are deleted; n_chars follows the text. A document that
    loses all of its words this way, a copy, goes. Rows without a doc_id stay as they are."""
    out = line_dedup.dedup(docs)
    changed = F.col("n_deleted") > 0
    out = out.where(~changed | (F.btrim("text", F.lit(quality_rules.BLANK)) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 on five-word shingles at 0.8: the least doc_id of each group stays, with all rows of it, and rows
    without a doc_id."""
    return without(docs, near_dedup.components(docs).where("NOT kept").select("doc_id").distinct())


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a benchmark item, in its own or other values, go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with the ids of their pieces, and whether these decode to the text."""
    return sentencepieces.checked(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmarks), ("sentencepiece", pieces)]
#: MinHash, patience diff and piece scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
