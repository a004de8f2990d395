"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomill.stash import discard, stash

FEW = 10_000  # edges up to which no node can be hot enough to matter


def _large_star(edges: DataFrame, least_of) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = least_of(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, least_of) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = least_of(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): every node of an edge and the smallest node that it reaches.

    Each round writes its edges to the shared folder, deletes the last round's, and ends when a round changes none,
    after O(log n) rounds. A node with very many edges is only ever a key of a partial aggregate or of a join that
    can be split: with more than ``FEW`` edges, what is joined is written first, so that both sides are plain exchanges.
    """
    now = stash(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v").distinct(), "edges")
    marked = lambda: now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = marked()
    while mark[0]:
        used = [now]

        def written(df: DataFrame) -> DataFrame:
            used.append(stash(df, "round"))
            return used[-1]

        if mark[0] > FEW:
            now = stash(_small_star(written(_large_star(now, written)), written), "edges")
        else:
            now = stash(_small_star(_large_star(now, lambda x: x), lambda x: x), "edges")
        discard(*used)
        last, mark = mark, marked()
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
