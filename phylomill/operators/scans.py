"""Numbers and running values in the order of a large table, without putting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phylomill.stash import stash


def _dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """Range partitions of the rows, each with its number; written, so that the numbers stay."""
    return stash(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their places from 0 on, by range partitions and a count of each."""
    dealt = _dealt(df, order)
    per = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = per.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn(name, place).join(F.broadcast(before), "part").select(*df.columns, (F.col(name) + F.col("before")).cast("long").alias(name))


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over the rows of their ``keys`` that come before them."""
    return running_sums(df, keys, order, {name: value})


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Like ``running`` for several values at once, by the names of their sums."""
    dealt = _dealt(df.withColumns({f"{name}_v": value for name, value in values.items()}), [*keys, *order])
    carried = dealt.groupBy(*keys, "part").agg(*[F.sum(f"{name}_v").alias(f"{name}_s") for name in values])  # rows: keys and partitions, not their product
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.select(*keys, "part", *[F.coalesce(F.sum(f"{name}_s").over(earlier), F.lit(0)).alias(f"{name}_s") for name in values])
    own = W.partitionBy("part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumns({name: F.coalesce(F.sum(f"{name}_v").over(own), F.lit(0)) for name in values})
    return placed.join(carried, [*keys, "part"]).select(*df.columns, *[(F.col(name) + F.col(f"{name}_s")).alias(name) for name in values])
