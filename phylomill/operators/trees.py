"""Rooted trees as edge tables (tree_id, parent, child[, length]): closure, ancestors' states, lengths and shape.

What needs no pair of a node and each of its ancestors goes by ``intervals``; ``spans`` are its intervals.

Labels are unique within a tree. Everything is keyed by tree_id, so many trees are handled at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phylomill.operators import contraction as ct
from phylomill.operators import intervals as iv
from phylomill.stash import stash

DEEP = 24  # levels up to which ancestors are made level by level


def closure(edges: DataFrame) -> DataFrame:
    """(tree_id, ancestor, node, distance): all pairs of a node and a proper ancestor, by pointer doubling.

    Round r joins paths of 2**r edges, so the rounds are log2 of the depth.
    """
    step = stash(edges.select("tree_id", F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance")), "paths")
    reached, jump = step, step
    while True:
        up = jump.select("tree_id", F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("d"))
        longer = stash(reached.join(up, ["tree_id", "ancestor"]).select("tree_id", F.col("top").alias("ancestor"), "node", (F.col("distance") + F.col("d")).alias("distance")), "paths")
        if longer.isEmpty():
            return reached
        lower = jump.select("tree_id", F.col("ancestor").alias("node"), F.col("node").alias("low"), F.col("distance").alias("d"))
        jump = stash(jump.join(lower, ["tree_id", "node"]).select("tree_id", "ancestor", F.col("low").alias("node"), (F.col("distance") + F.col("d")).alias("distance")), "paths")
        reached = stash(reached.unionByName(longer), "paths")


def tips(edges: DataFrame) -> DataFrame:
    """(tree_id, tip): children that are no parents."""
    inner = edges.select("tree_id", F.col("parent").alias("child")).distinct()
    return edges.select("tree_id", "child").join(inner, ["tree_id", "child"], "left_anti").select("tree_id", F.col("child").alias("tip"))


def roots(edges: DataFrame) -> DataFrame:
    """(tree_id, root)."""
    return edges.select("tree_id", "parent").distinct().join(edges.select("tree_id", F.col("child").alias("parent")), ["tree_id", "parent"], "left_anti").select("tree_id", F.col("parent").alias("root"))


def clades(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(tree_id, node, tip, distance) of every inner node and the tips below it."""
    paths = closure(edges) if paths is None else paths
    return paths.join(tips(edges).withColumnRenamed("tip", "node"), ["tree_id", "node"], "left_semi").select("tree_id", F.col("ancestor").alias("node"), F.col("node").alias("tip"), "distance")


def clade_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("tree_id", "node").agg(F.count("*").alias("size"))


def indel_ancestors(members: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, node, site, state) of irreversible multi-state characters: the state that all known tips below
    share, 0 where they differ; sites unknown to all tips below are in no row."""
    found = members.join(states, "tip").groupBy("tree_id", "node", "site").agg(F.min("state").alias("low"), F.max("state").alias("high"))
    return found.select("tree_id", "node", "site", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0).alias("state"))


def indel_states(edges: DataFrame, states: DataFrame) -> DataFrame:
    """``indel_ancestors`` of all inner nodes of ``edges``: tips are summed up in their parents first, and only these sums
    go to the nodes above."""
    inner = stash(edges.select("tree_id", "parent").distinct(), "inner-nodes")
    ways = edges.select("tree_id", "parent", "child").join(inner.withColumnRenamed("parent", "child"), ["tree_id", "child"], "left_semi")
    at = edges.select("tree_id", F.col("parent").alias("node"), F.col("child").alias("tip")).join(inner.withColumnRenamed("parent", "tip"), ["tree_id", "tip"], "left_anti")
    own = stash(at.join(states, "tip").groupBy("tree_id", "node", "site").agg(F.min("state").alias("low"), F.max("state").alias("high")), "own-tips")
    above = own.join(closure(ways), ["tree_id", "node"]).select("tree_id", F.col("ancestor").alias("node"), "site", "low", "high")
    found = own.unionByName(above).groupBy("tree_id", "node", "site").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return found.select("tree_id", "node", "site", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0).alias("state"))


def binary_ancestors(members: DataFrame, bits: DataFrame) -> DataFrame:
    """(tree_id, node, site) of irreversible bits: set in an ancestor if set in all tips below."""
    n = members.join(bits, "tip").groupBy("tree_id", "node", "site").agg(F.count("*").alias("n"))
    return n.join(clade_sizes(members), ["tree_id", "node"]).where("n = size").select("tree_id", "node", "site")


def levels(edges: DataFrame) -> DataFrame:
    """(tree_id, node, depth), the root at 0."""
    edges, found = edges.select("tree_id", "parent", "child"), iv._levels(edges)
    if found is None:
        depth = iv.lifted(edges).select("tree_id", "node", F.col("steps").cast("int").alias("depth"))
        return depth.unionByName(roots(edges).select("tree_id", F.col("root").alias("node"), F.lit(0).alias("depth")))
    top, below = found
    return _union([top.select("tree_id", "node", F.lit(0).alias("depth")), *[x.select("tree_id", F.col("child").alias("node"), F.lit(d).alias("depth")) for d, x in enumerate(below, 1)]])


def _two_passes(edges: DataFrame, tip_codes: DataFrame, depth: DataFrame, rule, settle, mask: int) -> DataFrame:
    """``rule(both, any)`` makes a node's code of what all and what any of its children allow, ``settle(code, above)`` a
    child's final one by its parent's. Level by level up to ``DEEP`` levels; deeper trees are contracted, with equal codes.

    Tips are summed up in their parents first, and only these sums and inner nodes' codes go through the levels. Tip
    codes that have their ``parent`` need not be joined with the edges for it."""
    if (depth.agg(F.max("depth")).first()[0] or 0) > DEEP:
        return ct.down(edges, ct.up(edges, tip_codes.drop("parent"), rule, mask), settle, mask)

    def down(rows):
        return rows.select("tree_id", "node", "site", settle(F.col("code"), F.col("above")).cast("int").alias("code"))

    edges = edges.select("tree_id", "parent", "child")
    if "parent" not in tip_codes.columns:
        tip_codes = tip_codes.join(edges.withColumnRenamed("child", "tip"), ["tree_id", "tip"])
    own = stash(tip_codes.groupBy("tree_id", F.col("parent").alias("node"), "site").agg(F.bit_and("code").alias("both"), F.bit_or("code").alias("any")), "own-codes")
    inner = edges.select("tree_id", F.col("parent").alias("node")).distinct()
    at = stash(depth.join(inner, ["tree_id", "node"], "left_semi").select("tree_id", "node", "depth"), "inner-depths")
    ways = stash(edges.withColumnRenamed("child", "node").join(at, ["tree_id", "node"]), "ways")
    own = stash(own.join(at, ["tree_id", "node"]), "own-levels")
    deepest = at.agg(F.max("depth")).first()[0] or 0
    made: list[DataFrame] = []  # from the root down
    for d in range(deepest, -1, -1):
        here = own.where(F.col("depth") == d).select("tree_id", "node", "site", "both", "any")
        if made:
            step = ways.where(F.col("depth") == d + 1).select("tree_id", "parent", "node")
            under = made[0].join(step, ["tree_id", "node"]).select("tree_id", F.col("parent").alias("node"), "site", F.col("code").alias("both"), F.col("code").alias("any"))
            here = here.unionByName(under).groupBy("tree_id", "node", "site").agg(F.bit_and("both").alias("both"), F.bit_or("any").alias("any"))
        made.insert(0, stash(here.select("tree_id", "node", "site", rule(F.col("both"), F.col("any")).cast("int").alias("code")), "up"))
    out = [stash(down(made[0].withColumn("above", F.lit(None).cast("int"))), "down")]
    for d in range(1, deepest + 1):
        step = ways.where(F.col("depth") == d).select("tree_id", "parent", "node")
        above = out[-1].select("tree_id", F.col("node").alias("parent"), "site", F.col("code").alias("above"))
        out.append(stash(down(made[d].join(step, ["tree_id", "node"]).join(above, ["tree_id", "parent", "site"])), "down"))
    return _union(out)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def reversible_ancestors(edges: DataFrame, tip_codes: DataFrame, depth: DataFrame) -> DataFrame:
    """(tree_id, node, site, code) of reversible bits; codes 1 unset, 2 set, and while undecided 3 either.

    Up: what all children allow, either where that is nothing. Down: an undecided root is unset, an undecided node
    takes its parent's state.
    """
    rule = lambda both, any_: F.when(both == 0, 3).otherwise(both)
    settle = lambda code, above: F.when(code != 3, code).otherwise(F.coalesce(above, F.lit(1)))
    return _two_passes(edges, tip_codes, depth, rule, settle, 3)


def dna_ancestors(edges: DataFrame, tip_codes: DataFrame, depth: DataFrame) -> DataFrame:
    """(tree_id, node, site, code) of base sets; the gap's bit takes part.

    Up: the bases all children allow, or any child's where that is none. Down: what the parent allows as well, if any.
    """

    def settle(code, above):
        both = code.bitwiseAND(F.coalesce(above, code))
        return F.when(both != 0, both).otherwise(code)

    return _two_passes(edges, tip_codes, depth, lambda both, any_: F.when(both != 0, both).otherwise(any_), settle, 31)


def changes(edges: DataFrame, states: DataFrame, kind: str = "indel") -> DataFrame:
    """(tree_id, parent, child, site) of changed sites along edges; ``states`` has (tree_id, node, site, state).

    indel: both known and different; dna: sets without a common base.
    """
    side = lambda x: states.select("tree_id", F.col("node").alias(x), "site", F.col("state").alias(f"s_{x}"))
    both = edges.select("tree_id", "parent", "child").join(side("parent"), ["tree_id", "parent"]).join(side("child"), ["tree_id", "child", "site"])
    differ = F.col("s_parent") != F.col("s_child") if kind == "indel" else F.col("s_parent").bitwiseAND(F.col("s_child")) == 0
    return both.where(differ).select("tree_id", "parent", "child", "site", "s_parent", "s_child")


def branch_lengths(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(tree_id, parent, child, length): changed sites of each edge, 0 for none."""
    n = changed.groupBy("tree_id", "child").agg(F.count("*").alias("length"))
    return edges.select("tree_id", "parent", "child").join(n, ["tree_id", "child"], "left").select("tree_id", "parent", "child", F.coalesce("length", F.lit(0)).alias("length"))


def changes_per_site(changed: DataFrame, inner: DataFrame | None = None, gap: int | None = None) -> DataFrame:
    """(tree_id, site, n); with ``inner`` (tree_id, node) only on edges to these, and with ``gap`` only from and to
    other states than this one."""
    if inner is not None:
        changed = changed.join(inner.select("tree_id", F.col("node").alias("child")).distinct(), ["tree_id", "child"], "left_semi")
    if gap is not None:
        changed = changed.where((F.col("s_parent") != gap) & (F.col("s_child") != gap))
    return changed.groupBy("tree_id", "site").agg(F.count("*").alias("n"))


def events(changed: DataFrame, weights: DataFrame) -> DataFrame:
    """(tree_id, events, weighted): changes on all edges, and the sum of their sites' ``weights`` (site, weight)."""
    return changed.join(weights, "site").groupBy("tree_id").agg(F.count("*").alias("events"), F.sum("weight").alias("weighted"))


def collapsed_by_support(edges: DataFrame, support: DataFrame, threshold: float) -> DataFrame:
    """``collapsed`` at the nodes with less ``support`` (tree_id, node, support) than ``threshold``."""
    return collapsed(edges, support.where(F.col("support") < threshold))


def gained(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, child, site, state): mutated states that a node has and its parent lacks."""
    have = states.where("state > 0").select("tree_id", "node", "site", "state")
    child = edges.select("tree_id", "parent", F.col("child").alias("node")).join(have, ["tree_id", "node"])
    above = have.withColumnRenamed("node", "parent")
    return child.join(above, ["tree_id", "parent", "site", "state"], "left_anti").select("tree_id", F.col("node").alias("child"), "site", "state")


def origins(gains: DataFrame) -> DataFrame:
    """(tree_id, site, state, n): how often each mutation arises."""
    return gains.groupBy("tree_id", "site", "state").agg(F.count("*").alias("n"))


def collapsed(edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """(tree_id, parent, child, length) without the inner nodes in ``dropped`` (tree_id, node).

    A node's new parent is its nearest ancestor that stays, and the lengths of the dropped ones between are added.
    """
    gone = dropped.select("tree_id", "node").distinct()
    stay = edges.select("tree_id", F.col("parent").alias("node")).distinct().join(gone, ["tree_id", "node"], "left_anti")
    up = iv.lifted(edges, stay).where("above IS NOT NULL").join(gone, ["tree_id", "node"], "left_anti")
    return up.select("tree_id", F.col("above").alias("parent"), F.col("node").alias("child"), "length")


def ultrametric(edges: DataFrame) -> DataFrame:
    """Edges whose tip lengths are extended so that all tips of a tree are as deep as its deepest."""
    depth = tips(edges).withColumnRenamed("tip", "node").join(iv.lifted(edges), ["tree_id", "node"]).select("tree_id", "node", F.col("length").alias("depth"))
    depth = stash(depth, "depths")
    most = depth.groupBy("tree_id").agg(F.max("depth").alias("most"))
    add = depth.join(most, "tree_id").select("tree_id", F.col("node").alias("child"), (F.col("most") - F.col("depth")).alias("add"))
    return edges.join(add, ["tree_id", "child"], "left").select("tree_id", "parent", "child", (F.col("length") + F.coalesce("add", F.lit(0.0))).alias("length"))


def subtree(edges: DataFrame, spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges below the given (tree_id, node), with ``node`` as the sub-tree's id."""
    under = iv.below(spans, nodes).select("tree_id", F.col("ancestor").alias("subtree"), F.col("node").alias("child"))
    return edges.join(under, ["tree_id", "child"]).select("tree_id", "subtree", "parent", "child", "length")


def pure_nodes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(tree_id, node, identity): the label (tip, label) that all tips below share, else '0'."""
    found = members.join(labels, "tip").groupBy("tree_id", "node").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return found.select("tree_id", "node", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("0").alias("identity"))


def ordered_tips(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(tree_id, tip, place): tips numbered in the order of ``order`` (tip, place)."""
    return tips(edges).join(order, "tip").select("tree_id", "tip", F.row_number().over(W.partitionBy("tree_id").orderBy("place")).alias("place"))


def topmost(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """The flagged (tree_id, node) that have no flagged proper ancestor."""
    nodes = flagged.select("tree_id", "node").distinct()
    under = iv.lifted(edges, nodes).where("above IS NOT NULL").select("tree_id", "node")
    return nodes.join(under, ["tree_id", "node"], "left_anti")


def stitched(backbone: DataFrame, parts: DataFrame) -> DataFrame:
    """(parent, child, length): pseudo-tips replaced by their clusters' trees.

    ``backbone`` has (parent, child, length); ``parts`` (pseudo, root, parent, child, length), whose own tips may be
    pseudo-tips again. A pseudo-tip's edge then leads to the root of its tree.
    """
    root = parts.select(F.col("pseudo").alias("child"), "root").distinct()
    every = backbone.select("parent", "child", "length").unionByName(parts.select("parent", "child", "length"))
    return every.join(root, "child", "left").select("parent", F.coalesce("root", "child").alias("child"), "length")
