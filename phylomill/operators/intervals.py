"""Trees as intervals, with rows linear in the nodes however deep a tree is.

Trees of up to ``DEEP`` levels are counted level by level, up for what is below a node and down for its place, so that a
node is read and written a few times. In deeper ones each edge is walked down and up once in a tour of its tree. List ranking by pointer jumping tells how much of the tour is
left at every half-edge, and with it a node's place in the order of the tour, the last place below it, its tips' places
and its depth. A clade is then a range of tip places, and "below" a range of node places.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomill.operators.scans import numbered, running, running_sums
from phylomill.stash import discard, stash

BLOCK = 256  # places that a range is dealt by
DEEP = 24  # levels up to which places are counted level by level


def intervals(edges: DataFrame) -> DataFrame:
    """(tree_id, node, enter, leave, first, tips, depth): the nodes below are those with a place in (enter, leave], the
    tips below those with one in [first, first + tips). Children go by their labels; the root has place and depth 0."""
    levels = _levels(edges)
    return _toured(edges) if levels is None else _counted_down(*levels)


def _levels(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]] | None:
    """Roots (tree_id, node), and the edges of each level from there down; none for trees of over ``DEEP`` levels."""
    inner = edges.select("tree_id", F.col("parent").alias("node")).distinct()
    # only edges between inner nodes, mostly few, lead to a further level
    ways = stash(edges.select("tree_id", "parent", "child").join(inner.withColumnRenamed("node", "child"), ["tree_id", "child"], "left_semi"), "inner-edges")
    if _deeper(ways):
        return None
    roots = stash(inner.join(edges.select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_anti"), "roots")
    at, depths = roots, []
    while not at.isEmpty():
        depths.append(at.withColumn("depth", F.lit(len(depths))))
        at = stash(ways.join(at.withColumnRenamed("node", "parent"), ["tree_id", "parent"]).select("tree_id", F.col("child").alias("node")), "level")
    if not depths:
        return roots, []
    depth = depths[0]
    for d in depths[1:]:
        depth = depth.unionByName(d)
    whole = stash(edges.select("tree_id", "parent", "child").join(depth.withColumnRenamed("node", "parent"), ["tree_id", "parent"]), "levels")
    return roots, [whole.where(F.col("depth") == d).drop("depth") for d in range(len(depths))]


def _deeper(ways: DataFrame) -> bool:
    """Whether some inner node has ``DEEP`` nodes above it, by paths of 8, 16 and 24 edges."""
    longer = lambda a, b: a.join(b.select("tree_id", F.col("child").alias("parent"), F.col("parent").alias("top")), ["tree_id", "parent"]).select("tree_id", F.col("top").alias("parent"), "child")
    two = longer(ways, ways)
    four = longer(two, two)
    eight = longer(four, four)
    if eight.isEmpty():
        return False
    return not longer(longer(eight, eight), eight).isEmpty()


def _counted_down(roots: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Nodes and tips below are summed up from the last level; a node comes after what its earlier siblings hold."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    held, below = [], None
    for edges in reversed(levels):
        size = edges.select("tree_id", "parent", "child")
        if below is None:
            size = size.select("*", one.alias("n"), one.alias("t"))
        else:
            size = size.join(below.withColumnRenamed("parent", "child"), ["tree_id", "child"], "left").select("tree_id", "parent", "child", (1 + F.coalesce("n", none)).alias("n"), F.coalesce("t", one).alias("t"))
        held.insert(0, running_sums(size, ["tree_id", "parent"], ["child"], {"n0": F.col("n"), "t0": F.col("t")}))
        below = stash(size.groupBy("tree_id", "parent").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "sums")
    top = roots if below is None else roots.join(below.withColumnRenamed("parent", "node"), ["tree_id", "node"])
    top = top.select("tree_id", "node", none.alias("enter"), (F.col("n") if below is not None else none).alias("leave"), none.alias("first"), (F.col("t") if below is not None else none).alias("tips"), none.alias("depth"))
    out = [stash(top, "places")]
    for edges in held:
        above = out[-1].select("tree_id", F.col("node").alias("parent"), F.col("enter").alias("e"), F.col("first").alias("f"), "depth")
        enter = F.col("e") + 1 + F.col("n0")
        out.append(stash(edges.join(above, ["tree_id", "parent"]).select("tree_id", F.col("child").alias("node"), enter.alias("enter"), (enter + F.col("n") - 1).alias("leave"), (F.col("f") + F.col("t0")).alias("first"), F.col("t").alias("tips"), (F.col("depth") + 1).alias("depth")), "places"))
    every = out[0]
    for level in out[1:]:
        every = every.unionByName(level)
    return every


def _toured(edges: DataFrame) -> DataFrame:
    e = stash(numbered(edges.select("tree_id", "parent", "child"), ["tree_id", "parent", "child"], "r"), "tour-edges")
    kids = stash(e.groupBy("tree_id", "parent").agg(F.min("r").alias("low"), F.max("r").alias("high")), "children")
    own = kids.select("tree_id", F.col("parent").alias("child"), "low")
    up = e.select("tree_id", F.col("child").alias("parent"), F.col("r").alias("above"))
    x = e.join(kids.drop("low"), ["tree_id", "parent"]).join(own, ["tree_id", "child"], "left").join(up, ["tree_id", "parent"], "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tip = F.when(F.col("low").isNull(), one).otherwise(none)
    half = lambda h, to, n, t, s: F.struct(h.alias("h"), to.cast("long").alias("to"), n.alias("n"), t.alias("t"), s.alias("s"))
    down = half(2 * F.col("r"), F.coalesce(2 * F.col("low"), 2 * F.col("r") + 1), one, tip, one)
    back = half(2 * F.col("r") + 1, F.when(F.col("r") < F.col("high"), 2 * F.col("r") + 2).otherwise(F.coalesce(2 * F.col("above") + 1, F.lit(-1))), none, none, -one)
    now = stash(x.select(F.explode(F.array(down, back)).alias("x")).select("x.*"), "tour")
    longest = e.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(max(2 * longest, 1))) if longest else 0):
        ahead = now.select(F.col("h").alias("to"), F.col("to").alias("to2"), *[F.col(c).alias(f"{c}2") for c in "nts"])
        new = now.where("to >= 0").join(ahead, "to").select("h", F.col("to2").alias("to"), *[(F.col(c) + F.col(f"{c}2")).alias(c) for c in "nts"])
        new = stash(now.where("to < 0").unionByName(new), "tour")
        discard(now)
        now = new
    at = lambda c, k: F.sum(F.when(F.col("h") % 2 == k, F.col(c)).otherwise(0))
    rest = now.groupBy(F.expr("h div 2").alias("r")).agg(at("n", 0).alias("n"), at("n", 1).alias("n2"), at("t", 0).alias("t"), at("t", 1).alias("t2"), at("s", 0).alias("s"))
    own = e.join(rest, "r")
    whole = stash(own.groupBy("tree_id").agg(F.count("*").alias("edges"), F.sum(F.when(F.col("n") - F.col("n2") == 1, 1).otherwise(0)).alias("every")), "trees")
    enter = F.col("edges") - F.col("n") + 1
    inner = own.join(whole, "tree_id").select("tree_id", F.col("child").alias("node"), enter.alias("enter"), (enter + F.col("n") - F.col("n2") - 1).alias("leave"), (F.col("every") - F.col("t")).alias("first"), (F.col("t") - F.col("t2")).alias("tips"), (1 - F.col("s")).alias("depth"))
    root = e.select("tree_id", F.col("parent").alias("node")).distinct().join(e.select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_anti").join(whole, "tree_id")
    return inner.unionByName(root.select("tree_id", "node", none.alias("enter"), F.col("edges").alias("leave"), none.alias("first"), F.col("every").alias("tips"), none.alias("depth")))


def sizes(spans: DataFrame) -> DataFrame:
    """(tree_id, node, size): tips below every inner node."""
    return spans.where("leave > enter").select("tree_id", "node", F.col("tips").alias("size"))


def below(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree_id, ancestor, node): all nodes under the given (tree_id, node); ranges meet places in blocks."""
    at = spans.join(nodes.select("tree_id", "node").distinct(), ["tree_id", "node"], "left_semi").where("leave > enter")
    block = lambda c: F.floor(F.col(c) / BLOCK)
    ranges = at.select("tree_id", F.col("node").alias("ancestor"), F.col("enter").alias("e"), F.col("leave").alias("l"), F.explode(F.sequence(F.floor((F.col("enter") + 1) / BLOCK), block("leave"))).alias("block"))
    places = spans.select("tree_id", "node", "enter", block("enter").alias("block"))
    return places.join(ranges, ["tree_id", "block"]).where("enter > e AND enter <= l").select("tree_id", "ancestor", "node")


def lifted(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(tree_id, node, above, length, steps): the nearest proper ancestor among ``stops`` (tree_id, node), null where there
    is none, and the sum of the edges' ``length`` and their number up to there, or else up to the root.

    Pointer jumping: rounds go with the logarithm of the depth, and rows of a round with the nodes.
    """
    length = F.col("length").cast("double") if "length" in edges.columns else F.lit(0.0)
    now = edges.select("tree_id", F.col("child").alias("node"), F.col("parent").alias("at"), length.alias("length"), F.lit(1).cast("long").alias("steps"))
    ends = edges.select("tree_id", F.col("parent").alias("at")).distinct().join(edges.select("tree_id", F.col("child").alias("at")), ["tree_id", "at"], "left_anti")
    ends = ends.withColumn("stop", F.lit(False))
    if stops is not None:
        chosen = stops.select("tree_id", F.col("node").alias("at")).distinct().withColumn("stop", F.lit(True))
        ends = ends.join(chosen.drop("stop"), ["tree_id", "at"], "left_anti").unionByName(chosen)
    ends = stash(ends, "stops")
    now = stash(now.join(ends, ["tree_id", "at"], "left"), "pointers")
    while not now.where("stop IS NULL").isEmpty():
        ahead = now.select("tree_id", F.col("node").alias("at"), F.col("at").alias("at2"), F.col("length").alias("l2"), F.col("steps").alias("s2"), F.col("stop").alias("stop2"))
        new = now.where("stop IS NULL").join(ahead, ["tree_id", "at"]).select("tree_id", F.col("at2").alias("at"), "node", (F.col("length") + F.col("l2")).alias("length"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("stop2").alias("stop"))
        new = stash(now.where("stop IS NOT NULL").unionByName(new), "pointers")
        discard(now)
        now = new
    return now.select("tree_id", "node", F.when(F.col("stop"), F.col("at")).alias("above"), "length", "steps")


def counted(spans: DataFrame, marks: DataFrame) -> DataFrame:
    """(tree_id, node, n): how many of the distinct ``marks`` (tree_id, node) each node's range holds, itself included."""
    own = spans.join(marks.select("tree_id", "node").distinct().withColumn("mark", F.lit(1).cast("long")), ["tree_id", "node"], "left")
    until = stash(running(own.select("tree_id", "node", "enter", "leave", F.coalesce("mark", F.lit(0).cast("long")).alias("mark")), ["tree_id"], ["enter"], F.col("mark"), "until"), "counts")
    every = until.groupBy("tree_id").agg(F.sum("mark").alias("every"))
    after = until.select("tree_id", (F.col("enter") - 1).alias("leave"), F.col("until").alias("past"))
    out = until.join(after, ["tree_id", "leave"], "left").join(every, "tree_id")
    return out.select("tree_id", "node", (F.coalesce("past", "every") - F.col("until")).alias("n"))


def runs_of(spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tree_id, set_id, first, last): for every chosen (set_id, tip) its place and the end of its run of chosen places."""
    own = spans.where("leave = enter").select("tree_id", F.col("node").alias("tip"), "first").join(chosen.select("set_id", "tip").distinct(), "tip").select("tree_id", "set_id", "first")
    placed = stash(running(own, ["tree_id", "set_id"], ["first"], F.lit(1).cast("long"), "k").withColumn("run", F.col("first") - F.col("k")), "runs")
    ends = stash(placed.groupBy("tree_id", "set_id", "run").agg(F.max("first").alias("last")), "run-ends")
    return placed.join(ends, ["tree_id", "set_id", "run"]).select("tree_id", "set_id", "first", "last")
