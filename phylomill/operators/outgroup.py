"""Checking solved clusters against their outgroups, breaking trees and joining the layers.

Node states (tree_id, node, site, state) hold known states only; outgroup characters (tip_id, site, state) likewise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phylomill.operators import neighbors as nb
from phylomill.operators import trees
from phylomill.stash import stash

MOST_BYTES = 64 << 20
MOST_SITES = 1024  # sites up to which bits are held as words of 64


def in_group(characters: DataFrame, clusters: DataFrame, layer: int, roots: DataFrame) -> DataFrame:
    """(cluster_id, tip, site, state) of a layer's clusters: members outside any cluster of the next layer as they
    are (``t:<id>``), child clusters as one pseudo-tip (``M:<id>``) with the root states (cluster_id, site, state)."""
    low = clusters.where(F.col("layer") == layer).where("cluster_id > 0").select("tip_id", "cluster_id")
    child = clusters.where(F.col("layer") == layer + 1).select("tip_id", F.col("cluster_id").alias("child"))
    member = low.join(child, "tip_id", "left").fillna(0, ["child"])
    single = member.where("child = 0").join(characters, "tip_id").select("cluster_id", F.concat(F.lit("t:"), F.col("tip_id").cast("string")).alias("tip"), "site", "state")
    pseudo = member.where("child > 0").select("cluster_id", "child").distinct().join(roots.select(F.col("cluster_id").alias("child"), "site", "state"), "child")
    return single.unionByName(pseudo.select("cluster_id", F.concat(F.lit("M:"), F.col("child").cast("string")).alias("tip"), "site", "state"))


def conflicts(node_states: DataFrame, outgroups: DataFrame, pairs: DataFrame, kind: str = "indel") -> DataFrame:
    """(tree_id, node, tip_id, n): how much speaks against an outgroup's place below a node.

    ``indel``: sites where the node is mutated and the outgroup is known and different. ``binary``: bits (state 2) that
    the node has and the outgroup hasn't. ``dna``: the node's unambiguous sites (one base) that the outgroup isn't
    compatible with, less the ambiguous ones that it is compatible with; a site without a row is a gap.
    ``pairs`` (tree_id, node, tip_id) says which to compare; pairs that share nothing come as well.
    """
    other = outgroups.select("tip_id", "site", F.col("state").alias("other"))
    if kind == "indel":
        own, other = node_states.where("state > 0"), other.where("other >= 0")
        n = pairs.join(own, ["tree_id", "node"]).join(other, ["tip_id", "site"]).where("state != other").groupBy("tree_id", "node", "tip_id").agg(F.count("*").alias("n"))
        return pairs.join(n, ["tree_id", "node", "tip_id"], "left").fillna(0, ["n"]).select("tree_id", "node", "tip_id", "n")
    if kind == "binary":
        own, alone = node_states.where("state = 2"), F.lit(1)
        met = F.lit(True)
        other = other.where("other = 2")
    else:
        own, alone = node_states.where("state != 16"), F.when(F.col("state").isin(1, 2, 4, 8), 1).otherwise(0)
        met = F.col("state").bitwiseAND(F.col("other")).bitwiseAND(15) != 0
    most = own.groupBy("tree_id", "node").agg(F.sum(alone).alias("most"))
    less = pairs.join(own, ["tree_id", "node"]).join(other, ["tip_id", "site"]).where(met).groupBy("tree_id", "node", "tip_id").agg(F.count("*").alias("less"))
    out = pairs.join(most, ["tree_id", "node"], "left").join(less, ["tree_id", "node", "tip_id"], "left").fillna(0, ["most", "less"])
    return out.select("tree_id", "node", "tip_id", (F.col("most") - F.col("less")).alias("n"))


def filtered(root_states: DataFrame, outgroups: DataFrame, cutoff: int, kind: str = "indel") -> DataFrame:
    """(tree_id, tip_id, n): outgroups with fewer than ``cutoff`` conflicts (see ``conflicts``) with the root of a tree.

    A root and an outgroup are a row each, with arrays of their cells, so a pair is judged where it is made, in time
    linear in the cells, and only pairs that pass go on. Bits of few sites are words instead of arrays. Roots are sent to
    all executors, ``MOST_BYTES`` of them at a time. Sequences (``dna``) meet in products of blocks.
    """
    if kind == "dna":
        return _filtered_sequences(root_states, outgroups, cutoff)
    site, state = F.col("site").cast("long"), F.col("state").cast("long")
    listed = lambda test, value: F.array_compact(F.collect_list(F.when(test, value)))
    shared = lambda x: F.size(F.array_intersect(f"own_{x}", f"has_{x}"))
    if kind == "indel":
        made = {"cells": (state > 0, state > 0, site * (1 << 16) + state), "sites": (state > 0, state >= 0, site)}
        n = shared("sites") - shared("cells")
    else:
        made = {"cells": (state == 2, state == 2, site)}
        n = F.size("own_cells") - shared("cells")
    words = _words(root_states) if kind == "binary" else 0
    if words:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (site % 64).cast("int"))
        held = lambda side: [F.coalesce(F.bit_or(F.when((state == 2) & (F.floor(site / 64) == w), bit)), F.lit(0).cast("long")).alias(f"{side}_{w}") for w in range(words)]
        n = sum((F.bit_count(F.col(f"own_{w}").bitwiseAND(F.bitwise_not(f"has_{w}"))) for w in range(words)), F.lit(0))
        mine, theirs, cells = held("own"), held("has"), F.count("*") * words
    else:
        mine, theirs = [listed(own, value).alias(f"own_{x}") for x, (own, _, value) in made.items()], [listed(has, value).alias(f"has_{x}") for x, (_, has, value) in made.items()]
    roots = stash(root_states.groupBy("tree_id", "node").agg(*mine).drop("node"), "roots")
    tips = outgroups.groupBy("tip_id").agg(*theirs)
    if not words:
        lists = [c for c in roots.columns if c.startswith("own_")]
        cells = sum((F.sum(F.size(c)) for c in lists), F.lit(0))
    total = roots.agg(F.count("*").alias("k"), cells.alias("cells")).first()
    parts = max(1, -(-(64 * total.k + 8 * (total.cells or 0)) // MOST_BYTES))
    tips = stash(tips, "outgroups") if parts > 1 else tips
    out = None
    for k in range(parts):
        part = roots.where(F.pmod(F.xxhash64("tree_id"), F.lit(parts)) == k) if parts > 1 else roots
        found = tips.crossJoin(F.broadcast(part)).select("tree_id", "tip_id", n.cast("long").alias("n")).where(F.col("n") < cutoff)
        out = found if out is None else out.unionByName(found)
    return out


def _filtered_sequences(root_states: DataFrame, outgroups: DataFrame, cutoff: int) -> DataFrame:
    roots = stash(root_states.select("tree_id", "node").distinct().withColumn("root", F.monotonically_increasing_id()), "root-ids")
    mine = root_states.join(roots, ["tree_id", "node"]).select(F.col("root").alias("tip_id"), "site", F.col("state").alias("code"))
    found = nb.dna_conflicts_below(mine, outgroups.select("tip_id", "site", F.col("state").alias("code")), cutoff)
    return found.join(nb._small(roots), "root").select("tree_id", "tip_id", "n")


def _words(root_states: DataFrame) -> int:
    """Words of 64 bits that hold all set sites of the roots; 0 where arrays are to be used."""
    ends = root_states.where("state = 2").agg(F.min("site").alias("low"), F.max("site").alias("high")).first()
    return 0 if ends.low is None or ends.low < 0 or ends.high >= MOST_SITES else ends.high // 64 + 1


def retained(edges: DataFrame, node_states: DataFrame, outgroups: DataFrame, near: DataFrame, cutoff: int, kind: str = "indel") -> DataFrame:
    """(tree_id, node): topmost inner nodes, roots excepted, with ``cutoff`` conflicts or more with every outgroup of
    their tree in ``near`` (tree_id, tip_id)."""
    inner = edges.select("tree_id", F.col("parent").alias("node")).distinct().join(edges.select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_semi")
    pairs = inner.join(near.select("tree_id", "tip_id"), "tree_id")
    least = conflicts(node_states, outgroups, pairs, kind).groupBy("tree_id", "node").agg(F.min("n").alias("least"))
    good = inner.join(least, ["tree_id", "node"], "left").where(F.coalesce(F.col("least") >= cutoff, F.lit(True))).select("tree_id", "node")
    return trees.topmost(edges, good)


def broken(members: DataFrame, kept: DataFrame) -> DataFrame:
    """(tree_id, tip, piece): the retained node above each tip, '0' for tips that go to the layer above."""
    own = members.select("tree_id", "tip").distinct()
    under = members.join(kept, ["tree_id", "node"], "left_semi").select("tree_id", "tip", F.col("node").alias("piece"))
    return own.join(under, ["tree_id", "tip"], "left").fillna("0", ["piece"])


def layer_ids(pieces: DataFrame, start: int = 0) -> DataFrame:
    """(tree_id, piece, cluster_id): new ids after ``start`` by tree and piece, made from counts by tree."""
    own = pieces.where("piece != '0'").select("tree_id", "piece").distinct()
    per = own.groupBy("tree_id").agg(F.count("*").alias("n"))
    offset = per.select("tree_id", F.coalesce(F.sum("n").over(W.orderBy("tree_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("tree_id").orderBy("piece")))
    return ranked.join(offset, "tree_id").select("tree_id", "piece", (F.col("o") + F.col("r") + start).cast("long").alias("cluster_id"))


def summarized(clusters: DataFrame, layer: int, pieces: DataFrame) -> DataFrame:
    """``clusters`` after a layer is solved: tips outside all of its clusters take over their cluster of the layer below,
    members of a broken cluster get the id of their piece (new ids, see ``layer_ids``) or else their cluster of the layer
    below, and clusters that stayed whole keep their id.

    ``pieces`` (cluster_id, tip_id, piece): all members of the broken clusters, '0' for tips in no piece.
    """
    top = clusters.agg(F.max("cluster_id")).first()[0] or 0
    rows = pieces.select(F.col("cluster_id").alias("tree_id"), "tip_id", "piece")
    new = rows.join(layer_ids(rows, top).withColumnRenamed("cluster_id", "new"), ["tree_id", "piece"], "left").select(F.col("tree_id").alias("cluster_id"), "tip_id", "new", F.lit(True).alias("broken"))
    here = clusters.where(F.col("layer") == layer).select("tip_id", "layer", "cluster_id")
    child = clusters.where(F.col("layer") == layer + 1).select("tip_id", F.col("cluster_id").alias("child"))
    here = here.join(child, "tip_id", "left").join(new, ["cluster_id", "tip_id"], "left").fillna(0, ["child"])
    value = F.when(F.col("cluster_id") == 0, F.col("child")).when(F.col("broken"), F.coalesce("new", "child")).otherwise(F.col("cluster_id"))
    return clusters.where(F.col("layer") != layer).select("tip_id", "layer", "cluster_id").unionByName(here.select("tip_id", "layer", value.alias("cluster_id")))


def leaf_sets(parents: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, tip): tips of a cluster through all clusters nested in it; ``parents`` (parent, child)."""
    paths = trees.closure(parents.select(F.lit("c").alias("tree_id"), F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child")))
    deep = paths.select(F.col("ancestor").alias("cluster_id"), F.col("node").alias("inner"))
    own = members.select(F.col("cluster_id").cast("string").alias("inner"), "tip")
    return deep.join(own, "inner").select("cluster_id", "tip").unionByName(own.select(F.col("inner").alias("cluster_id"), "tip")).distinct()
