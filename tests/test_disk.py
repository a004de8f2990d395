"""What jobs leave on disk: shuffles go with the write that made them, and blocks meet without being copied to their pairs."""

from pyspark.sql import functions as F

from phylomill.operators import neighbors as nb
from phylomill.stash import stash


def test_shuffles_go_with_the_write(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in manager.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = shuffles()
    table = stash(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")))
    assert not shuffles() - before and table.count() == 10


def test_pairs_of_blocks_need_no_shuffle(spark):
    rows = spark.createDataFrame([(t, m, 1.0) for t in range(40) for m in range(8) if (t + m) % 5], "tip_id long, mut_id long, weight double")
    _, reps = nb.classes(rows)
    plan = nb.near_classes(reps, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_weights_go_to_classes(spark, monkeypatch):
    """As many classes as there are without weights, and the pairs of tips of each weighting."""
    names, bags = [], {t: {t % 4, 5, 6, 4 + t % 2} for t in range(30)}
    keep = nb.stash
    monkeypatch.setattr(nb, "stash", lambda df, name="table": names.append((name, df.columns)) or keep(df, name))
    weight = {(k, m): (m + k) / 4 for k in (1, 2) for m in range(8)}
    tips = spark.createDataFrame([(t, m) for t, bag in bags.items() for m in bag], "tip_id long, mut_id long")
    given = spark.createDataFrame([(k, m, w) for (k, m), w in weight.items()], "rep int, mut_id long, weight double")
    got = nb.weighted_within_radius(tips, given, 4.0, ["rep"])
    want = [(k, a, b, s) for k in (1, 2) for a in bags for b in bags if (s := sum(weight[k, m] for m in bags[a] & bags[b])) >= 4]
    assert got.columns == ["rep", "a", "b", "shared"] and sorted(map(tuple, got.collect())) == sorted(want) and want
    assert [c for name, c in names if name == "classes"] == [["mark", "cells", "rep", "size"]]
