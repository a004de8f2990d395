"""Character matrices from tables and PHYLIP-like text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_wide(rows: DataFrame, tip: str = "tip") -> DataFrame:
    """(tip, site, state) of a table with a column for each site, numbered from 0 in column order; -1 and null go."""
    names = [c for c in rows.columns if c != tip]
    cells = F.array(*[F.col(f"`{c}`").cast("int") for c in names])
    return rows.select(F.col(tip).alias("tip"), F.posexplode(cells).alias("site", "state")).where("state >= 0")


def read_csv(spark: SparkSession, path: str, tip: str = "tip") -> DataFrame:
    return from_wide(spark.read.option("header", True).csv(path), tip)


def from_digits(rows: DataFrame) -> DataFrame:
    """(tip, site, state) of (tip, digits) rows with a digit for each site; other characters are missing."""
    cells = rows.select("tip", F.posexplode(F.split("digits", "")).alias("site", "c"))
    return cells.where(F.col("c").rlike("^[0-9]$")).select("tip", "site", F.col("c").cast("int").alias("state"))


def read_phylip(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """Lines ``name digits`` after ``skip`` heading lines."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    heading = lines.orderBy("id").limit(skip).select("id")
    parts = F.split(F.trim("value"), r"\s+", 2)
    return from_digits(lines.join(F.broadcast(heading), "id", "left_anti").select(parts[0].alias("tip"), parts[1].alias("digits")))
