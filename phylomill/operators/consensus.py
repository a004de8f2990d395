"""Consensus of many trees by nearest clades, and rebuilding a tree from it.

Distances are (tree_id, node, size, other_tree, other, distance) rows of ``support.nearest_clades``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomill.operators import trees
from phylomill.stash import stash


def supported(nearest: DataFrame, threshold: float, n_trees: int) -> DataFrame:
    """(tree_id, node, size, hits): clades within ``threshold`` of their size in more than half of all trees, their
    own included."""
    hit = F.when(F.col("distance") <= threshold * F.col("size"), 1).otherwise(0)
    n = nearest.groupBy("tree_id", "node", "size").agg((F.sum(hit) + 1).alias("hits"))
    return n.where(F.col("hits") * 2 > n_trees)


def consensus_clades(nearest: DataFrame, threshold: float, trees_: list[str]) -> DataFrame:
    """(tree_id, node, size): supported clades, tree after tree; those that a consensus clade of an earlier tree has
    as its nearest within the threshold are skipped."""
    good = stash(supported(nearest, threshold, len(trees_)), "supported")
    near = stash(nearest.where(F.col("distance") <= threshold * F.col("size")).select("tree_id", "node", "other_tree", "other"), "within")
    kept = None
    for t in trees_:
        own = good.where(F.col("tree_id") == t).select("tree_id", "node", "size")
        if kept is not None:
            taken = kept.join(near, ["tree_id", "node"]).where(F.col("other_tree") == t).select(F.col("other_tree").alias("tree_id"), F.col("other").alias("node")).distinct()
            own = own.join(taken, ["tree_id", "node"], "left_anti")
        kept = stash(own if kept is None else kept.unionByName(own), "consensus")
    return kept


def fitted(edges: DataFrame, members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(set_id, at, child): the children of a node that together come closest to a set of tips (set_id, tip).

    From the root, children at most twice as large as what they hold of the set are picked; if the picked ones
    differ from the set by ``threshold`` of its size or less, they are the fit. Otherwise the search goes on in the
    child that holds 1 - threshold of the set, if there is one. One tree; all sets move down together.
    """
    edges = edges.select(F.col("parent").alias("at"), "child")
    own = members.select(F.col("node").alias("child"), "tip").unionByName(trees.tips(edges.select(F.lit("x").alias("tree_id"), F.col("at").alias("parent"), "child")).select(F.col("tip").alias("child"), "tip"))
    own = stash(own, "below")
    size = own.groupBy("child").agg(F.count("*").alias("m"))
    total = stash(sets.groupBy("set_id").agg(F.count("*").alias("n")), "sets")
    inside = stash(own.join(sets, "tip").groupBy("set_id", "child").agg(F.count("*").alias("i")).join(size, "child").join(edges, "child"), "inside")
    root = edges.select("at").distinct().join(edges.select(F.col("child").alias("at")), "at", "left_anti")
    now = total.crossJoin(root)
    found = None
    while True:
        here = stash(now.join(inside, ["set_id", "at"]), "here")
        picked = here.where("m <= 2 * i")
        gap = picked.groupBy("set_id").agg(F.sum("i").alias("pi"), F.sum("m").alias("pm"))
        fits = now.join(gap, "set_id").where(F.col("n") + F.col("pm") - 2 * F.col("pi") <= threshold * F.col("n")).select("set_id")
        fits = stash(fits, "fits")
        new = picked.join(fits, "set_id", "left_semi").select("set_id", "at", "child")
        found = stash(new if found is None else found.unionByName(new), "fitted")
        inner = edges.select(F.col("at").alias("child")).distinct()
        down = here.where(F.col("i") >= (1 - threshold) * F.col("n")).join(fits, "set_id", "left_anti").join(inner, "child", "left_semi")
        now = stash(down.select("set_id", "n", F.col("child").alias("at")), "down")
        if now.isEmpty():
            return found


def consensus_tree(edges: DataFrame, members: DataFrame, clades: DataFrame, reference: str, threshold: float) -> DataFrame:
    """(parent, child): the reference tree with its consensus clades only, and other trees' consensus clades added.

    Sets that overlap a larger one wait for a later round; a fitted set of two or more children gets a node
    ``c:<set_id>``.
    """
    own = stash(edges.where(F.col("tree_id") == reference).withColumn("length", F.lit(0.0)).select("tree_id", "parent", "child", "length"), "edges")
    mine = clades.where(F.col("tree_id") == reference).select("node")
    inner = own.select(F.col("parent").alias("node")).distinct().join(own.select(F.col("child").alias("node")), "node", "left_semi")
    drop = inner.join(mine, "node", "left_anti").withColumn("tree_id", F.lit(reference))
    now = stash(trees.collapsed(own, drop).select("tree_id", "parent", "child"), "edges")
    other = clades.where(F.col("tree_id") != reference).join(members, ["tree_id", "node"]).select(F.concat_ws("/", "tree_id", "node").alias("set_id"), "tip")
    left = stash(other, "sets")
    from phylomill.operators.support import deferred

    while not left.isEmpty():
        fit = stash(fitted(now, trees.clades(now), left, threshold), "fit")
        siblings = now.groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("all"))
        proper = fit.join(fit.groupBy("set_id").agg(F.count("*").alias("k")), "set_id").join(siblings, "at").where("k > 1 AND k < all").select("set_id", "at", "child")
        wait = deferred(proper.select("set_id", F.col("child").alias("node")))
        put = stash(proper.join(wait, "set_id", "left_anti"), "put")
        if put.isEmpty():
            break
        node = F.concat(F.lit("c:"), F.col("set_id"))
        moved = now.join(put.select("child", node.alias("new")), "child", "left").select("tree_id", F.coalesce("new", "parent").alias("parent"), "child")
        added = put.select(F.lit(reference).alias("tree_id"), F.col("at").alias("parent"), node.alias("child")).distinct()
        now = stash(moved.unionByName(added), "edges")
        left = stash(left.join(wait, "set_id", "left_semi"), "sets")
    return now.select("parent", "child")


def ordered(trees_: DataFrame) -> list[str]:
    """The tree ids in order; few, as each is a row of a small table."""
    return [r.tree_id for r in trees_.select("tree_id").distinct().orderBy("tree_id").collect()]

