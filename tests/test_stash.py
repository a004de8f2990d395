from pyspark.sql import functions as F

from phylomill.stash import stash


def test_well_compressed_rows_are_not_broadcast_by_the_size_of_their_file(spark):
    """Two million rows in a file of well under the 10 MB up to which a table is sent to the driver."""
    big = spark.range(2_000_000).select(F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("node"), F.pmod(F.hash("id"), F.lit(30)).alias("site"), F.lit("A").alias("tree_id"))
    one, two = stash(big, "one"), stash(big, "two")
    plan = one.join(two, ["tree_id", "node", "site"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    few = stash(spark.range(10).select(F.col("id").alias("node")), "few")
    assert "BroadcastHashJoin" in one.join(few, "node")._jdf.queryExecution().executedPlan().toString()
