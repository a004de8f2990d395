"""Comparing trees by their clades: exact and approximate support, distances, nested sets and clones.

Clade tables have (tree_id, node, tip). Exact comparisons join on a key of size and two order-free hash sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phylomill.operators import intervals as iv
from phylomill.operators.scans import numbered
from phylomill.operators.trees import topmost
from phylomill.stash import stash

def clade_keys(members: DataFrame, rooted: bool = True) -> DataFrame:
    """(tree_id, node, size, h1, h2); unrooted: of the side of the split that lacks the tree's least tip."""
    h1, h2 = F.xxhash64("tip").alias("a"), F.xxhash64(F.lit(1), F.reverse("tip")).alias("b")
    rows = members.select("tree_id", "node", "tip", h1, h2)
    keys = rows.groupBy("tree_id", "node").agg(F.count("*").alias("size"), F.bit_xor("a").alias("h1"), F.bit_xor("b").alias("h2"), F.min("tip").alias("low"))
    if rooted:
        return keys.drop("low")
    tips = rows.select("tree_id", "tip", "a", "b").distinct().groupBy("tree_id").agg(F.count("*").alias("n"), F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"), F.min("tip").alias("least"))
    flip = F.col("low") == F.col("least")
    return keys.join(tips, "tree_id").select("tree_id", "node", F.when(flip, F.col("n") - F.col("size")).otherwise(F.col("size")).alias("size"), F.when(flip, F.col("h1").bitwiseXOR(F.col("ta"))).otherwise(F.col("h1")).alias("h1"), F.when(flip, F.col("h2").bitwiseXOR(F.col("tb"))).otherwise(F.col("h2")).alias("h2"))


def exact_support(keys: DataFrame, reference: str) -> DataFrame:
    """(node, size, support): trees other than the reference that have the clade; the root is left out."""
    ref, rest = keys.where(F.col("tree_id") == reference), keys.where(F.col("tree_id") != reference)
    top = ref.agg(F.max("size").alias("top"))
    n = ref.select("node", "size", "h1", "h2").join(rest.select("tree_id", "size", "h1", "h2"), ["size", "h1", "h2"]).groupBy("node").agg(F.countDistinct("tree_id").alias("support"))
    return ref.crossJoin(F.broadcast(top)).where("size < top").join(n, "node", "left").select("node", "size", F.coalesce("support", F.lit(0)).alias("support"))


def robinson_foulds(keys: DataFrame) -> DataFrame:
    """(x, y, distance, normalised) for tree pairs x < y: clades that only one of them has, and their share of all."""
    sets = keys.select("tree_id", "size", "h1", "h2").distinct()
    n = sets.groupBy("tree_id").agg(F.count("*").alias("n"))
    pair = n.select(F.col("tree_id").alias("x"), F.col("n").alias("nx")).join(n.select(F.col("tree_id").alias("y"), F.col("n").alias("ny")), F.expr("x < y"))
    both = sets.withColumnRenamed("tree_id", "x").join(sets.withColumnRenamed("tree_id", "y"), ["size", "h1", "h2"]).where("x < y").groupBy("x", "y").agg(F.count("*").alias("common"))
    out = pair.join(both, ["x", "y"], "left").fillna(0, ["common"])
    return out.select("x", "y", (F.col("nx") + F.col("ny") - 2 * F.col("common")).alias("distance"), ((F.col("nx") + F.col("ny") - 2 * F.col("common")) / (F.col("nx") + F.col("ny"))).alias("normalised"))


def clade_distances(left: DataFrame, right: DataFrame, ratio: float | None = None) -> DataFrame:
    """(tree_id, node, size, other_tree, other, other_size, distance): symmetric difference of overlapping clades.

    ``ratio`` leaves out pairs whose sizes alone differ by more than that share of the left one.
    """
    a = left.withColumn("size", F.count("*").over(W.partitionBy("tree_id", "node")))
    b = right.select(F.col("tree_id").alias("other_tree"), F.col("node").alias("other"), "tip", F.count("*").over(W.partitionBy("tree_id", "node")).alias("other_size"))
    pairs = a.join(b, "tip").where("tree_id != other_tree")
    if ratio is not None:
        pairs = pairs.where(F.abs(F.col("size") - F.col("other_size")) <= ratio * F.col("size"))
    met = pairs.groupBy("tree_id", "node", "size", "other_tree", "other", "other_size").agg(F.count("*").alias("i"))
    return met.select("tree_id", "node", "size", "other_tree", "other", "other_size", (F.col("size") + F.col("other_size") - 2 * F.col("i")).alias("distance"))


def nearest_clades(distances: DataFrame) -> DataFrame:
    """(tree_id, node, size, other_tree, other, distance): the nearest clade of each other tree; ties: the larger, then
    the greater label."""
    w = W.partitionBy("tree_id", "node", "other_tree").orderBy("distance", F.desc("other_size"), F.desc("other"))
    return distances.withColumn("r", F.row_number().over(w)).where("r = 1").select("tree_id", "node", "size", "other_tree", "other", "distance")


def approximate_support(nearest: DataFrame, threshold: float) -> DataFrame:
    """(tree_id, node, size, support): share of the other trees whose nearest clade is within threshold * size."""
    hit = F.when(F.col("distance") <= threshold * F.col("size"), 1).otherwise(0)
    n = nearest.select("other_tree").union(nearest.select("tree_id")).distinct().agg((F.count("*") - 1).alias("n"))
    return nearest.groupBy("tree_id", "node", "size").agg(F.sum(hit).alias("s")).crossJoin(F.broadcast(n)).select("tree_id", "node", "size", (F.col("s") / F.col("n")).alias("support"))


def transfer_distances(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, node, light, other_tree, distance): least number of tips to move, over both sides of every split.

    min(d, n - d) over the other tree's clades, with d the symmetric difference. Overlapping clades are joined. Of the
    disjoint ones, with d = |A| + |B|, the least and the largest decide. The least clade of the whole tree does for the
    first: were it to overlap, its own d is less. The largest disjoint clade hangs off a node that A meets, or off the
    root: of such a node's children, k of them met, one of the k + 1 largest isn't. ``edges`` are those of ``right``.
    """
    n = left.groupBy("tree_id").agg(F.countDistinct("tip").alias("n"))
    sizes = stash(right.groupBy("tree_id", "node").agg(F.count("*").alias("m")), "sizes")
    pairs = stash(clade_distances(left, right).select("tree_id", "node", "other_tree", "other", "distance"), "pairs")
    own = left.groupBy("tree_id", "node").agg(F.count("*").alias("size")).join(n, "tree_id")
    least = sizes.groupBy(F.col("tree_id").alias("other_tree")).agg(F.min("m").alias("least"))
    every = stash(own.join(F.broadcast(least), F.col("tree_id") != F.col("other_tree")), "clades-and-trees")  # a row for each tree
    near = pairs.join(own, ["tree_id", "node"]).groupBy("tree_id", "node", "other_tree").agg(F.min(F.least("distance", F.col("n") - F.col("distance"))).alias("d"))
    # children that are clades, the largest first
    kids = edges.select("tree_id", "parent", F.col("child").alias("node")).join(sizes, ["tree_id", "node"])
    placed = stash(numbered(kids.withColumn("down", -F.col("m")), ["tree_id", "parent", "down", "node"], "place"), "children")
    first = placed.groupBy("tree_id", "parent").agg(F.min("place").alias("first"))
    ranked = placed.join(first, ["tree_id", "parent"]).select(F.col("tree_id").alias("other_tree"), "parent", F.col("node").alias("other"), "m", (F.col("place") - F.col("first") + 1).alias("rank"))
    up = edges.select(F.col("tree_id").alias("other_tree"), F.col("child").alias("other"), "parent")
    met = pairs.join(up, ["other_tree", "other"]).groupBy("tree_id", "node", "other_tree", "parent").agg(F.count("*").alias("k"))
    tops = edges.select(F.col("tree_id").alias("other_tree"), "parent").distinct().join(up.select("other_tree", F.col("other").alias("parent")), ["other_tree", "parent"], "left_anti")
    over = pairs.select("tree_id", "node", "other_tree", F.col("other").alias("parent")).unionByName(every.select("tree_id", "node", "other_tree").join(tops, "other_tree")).distinct()
    over = over.join(met, ["tree_id", "node", "other_tree", "parent"], "left").withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("k", F.lit(0)) + 1)))
    apart = over.join(ranked, ["other_tree", "parent", "rank"]).join(pairs.select("tree_id", "node", "other_tree", "other"), ["tree_id", "node", "other_tree", "other"], "left_anti")
    far = apart.groupBy("tree_id", "node", "other_tree").agg(F.max("m").alias("most"))
    out = every.join(near, ["tree_id", "node", "other_tree"], "left").join(far, ["tree_id", "node", "other_tree"], "left")
    best = F.least("d", F.col("size") + F.col("least"), F.col("n") - F.col("size") - F.col("most"))
    return out.select("tree_id", "node", F.least("size", F.col("n") - F.col("size")).alias("light"), "other_tree", best.alias("distance"))


def maximal_flagged(edges: DataFrame, flagged: DataFrame, below: DataFrame) -> DataFrame:
    """(tree_id, top, node): flagged nodes under each ``below`` (tree_id, node) with no flagged one in between.

    From every flagged node up, over tops, to the next flagged one; a step for each row that comes out.
    """
    flags = flagged.select("tree_id", "node").distinct().withColumn("flag", F.lit(True))
    tops = below.select("tree_id", "node").distinct().withColumn("top", F.lit(True))
    both = stash(flags.join(tops, ["tree_id", "node"], "full"), "marks")
    up = iv.lifted(edges, both).where("above IS NOT NULL").select("tree_id", "node", F.col("above"))
    up = stash(up.join(both.withColumnRenamed("node", "above"), ["tree_id", "above"]), "steps")
    now, found = up.join(flags.drop("flag"), ["tree_id", "node"], "left_semi"), None
    while True:
        now = stash(now.select("tree_id", "node", "above", "flag", "top"), "climbing")
        hit = now.where("top").select("tree_id", F.col("above").alias("top"), "node")
        found = hit if found is None else found.unionByName(hit)
        going = now.where("flag IS NULL")
        if going.isEmpty():
            return found
        ahead = up.select("tree_id", F.col("node").alias("here"), F.col("above").alias("a2"), F.col("flag").alias("f2"), F.col("top").alias("t2"))
        going = going.select("tree_id", "node", F.col("above").alias("here")).join(ahead, ["tree_id", "here"])
        now = going.select("tree_id", "node", F.col("a2").alias("above"), F.col("f2").alias("flag"), F.col("t2").alias("top"))


def maximal_nested(edges: DataFrame, spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tree_id, set_id, node, size): largest clades whose tips all belong to a set (set_id, tip).

    A clade belongs to a set if its places lie in one run of the set's places, the run that its first tip is in.
    """
    inner = spans.where("leave > enter").select("tree_id", "node", "first", F.col("tips").alias("size"))
    inside = inner.join(stash(iv.runs_of(spans, chosen), "runs"), ["tree_id", "first"]).where("first + size - 1 <= last").select("tree_id", "set_id", "node", "size")
    inside = stash(inside, "nested")
    up = edges.select("tree_id", F.col("child").alias("node"), "parent")
    over = inside.join(up, ["tree_id", "node"]).join(inside.select("tree_id", "set_id", F.col("node").alias("parent")), ["tree_id", "set_id", "parent"], "left_semi").select("tree_id", "set_id", "node")
    return inside.join(over, ["tree_id", "set_id", "node"], "left_anti")


def deferred(sets: DataFrame) -> DataFrame:
    """(set_id): sets (set_id, node) that share a node with a larger set, or with one as large of a smaller id."""
    size = sets.groupBy("set_id").agg(F.count("*").alias("n"))
    rows = sets.join(size, "set_id")
    best = rows.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("set_id").alias("winner"))).alias("b"))
    return rows.join(best.select("node", "b.winner"), "node").where("set_id != winner").select("set_id").distinct()


def clones(edges: DataFrame, support: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(tree_id, node): topmost non-root clades with at least this support."""
    good = support.where(F.col("support") >= threshold).select("tree_id", "node").join(roots.withColumnRenamed("root", "node"), ["tree_id", "node"], "left_anti")
    return topmost(edges, good)
