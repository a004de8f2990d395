"""Clusters of tips from neighbour lists: links, regular ids, nesting, quality and summaries.

Neighbour lists have (a, b); cluster tables (tip_id, layer, cluster_id) with 0 for tips without a cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomill.operators import neighbors as nb
from phylomill.operators.components import connected_components
from phylomill.operators.scans import numbered
from phylomill.stash import stash

PRODUCT = 100  # multiplications of a product that take as long as looking up a row
LISTED, FEW = 1 << 19, 1 << 14  # members of the lists of a block, and of one that is made for a further core only
MARKS = 1 << 26  # cells of a table of lists' members


def links(neighbors: DataFrame, share: float, keys: list[str] | None = None, min_shared: int = 0, sqrt: bool = False) -> DataFrame:
    """(keys.., i, j): neighbours i < j whose lists share ``min_shared`` or more, and more than ``share`` of the
    shorter list; ``sqrt``: of the geometric mean of both lengths. With a column ``size`` of ``neighbors`` each b counts
    for so many tips.

    One list of each pair of neighbours is looked up in the other, between blocks of lists. Where so many tips are
    neighbours that products of blocks of lists are cheaper, by a bound from the lengths of the lists, these are made
    instead.
    ``neighbors`` is read several times; pass a written table.
    """
    keys = keys or []
    if "size" not in neighbors.columns:
        neighbors = neighbors.withColumn("size", F.lit(1).cast("long"))
    n = stash(neighbors.groupBy(*keys, "a").agg(F.count("*").alias("k")), "list-sizes")
    k, m = F.col("k").cast("double"), F.col("m").cast("double")
    cost = n.groupBy(*keys).agg(F.sum(k * k / 2).alias("rows"), F.count("*").alias("m")).agg(F.sum("rows").alias("rows"), F.sum(m * m * m).alias("cells")).first()
    if cost.rows is not None and cost.cells < PRODUCT * cost.rows:
        above = lambda m, k: share * (np.sqrt(m * k) if sqrt else np.minimum(m, k))
        near = neighbors.where("a < b").select(*keys, F.col("a").alias("i"), F.col("b").alias("j"))
        return nb.overlapping(neighbors, min_shared, above, keys).select(*keys, F.col("a").alias("i"), F.col("b").alias("j")).where("i < j").join(near, [*keys, "i", "j"], "left_semi")
    return _by_lists(neighbors, share, keys, min_shared, sqrt)


def _by_lists(neighbors: DataFrame, share: float, keys: list[str], min_shared: int, sqrt: bool) -> DataFrame:
    """``links`` by looking up one list of each pair of neighbours in the other. Lists are dealt into blocks of about LISTED
    members, and those that two blocks hold of each other are neighbours, so that no pair is a row of a shuffle."""
    members = neighbors.count()
    blocks = max(1, members // LISTED, min(members // FEW, nb.SPREAD))
    lists = neighbors.groupBy(*keys, "a").agg(F.collect_list("b").alias("m"), F.collect_list("size").alias("w"))
    dealt = nb._dealt(lists.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks))), keys, blocks, "a", "m", "w")
    kept = [f"{k} {t}" for k, t in neighbors.select(*keys).dtypes]
    return nb._paired(dealt, keys).mapInArrow(_linked(share, keys, min_shared, sqrt), ", ".join([*kept, "i long", "j long"]))


def _linked(share: float, keys: list[str], min_shared: int, sqrt: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The links between the lists of a block pair x <= y."""

    def unpacked(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
        """Owners, where their lists begin, members, members' sizes, and sizes of the lists."""
        a, m, w = rows.flatten()
        at, w_ = np.append(0, np.cumsum(m.value_lengths().to_numpy())), w.flatten().to_numpy()
        return a.to_numpy(), at, m.flatten().to_numpy(), w_, np.add.reduceat(w_, at[:-1])

    def found(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links i < j of an owner i in ``p`` with an owner j in ``q`` that i's list has."""
        row = np.repeat(np.arange(len(p[0])), np.diff(p[1]))
        order = np.argsort(q[0])
        place = np.minimum(np.searchsorted(q[0], p[2], sorter=order), len(order) - 1)
        near = (q[0][order[place]] == p[2]) & (p[0][row] < p[2])
        i, j = row[near], order[place[near]]
        expected = share * (np.sqrt(p[4][i] * q[4][j]) if sqrt else np.minimum(p[4][i], q[4][j]))
        some = np.minimum(p[4][i], q[4][j]) > expected
        i, j, expected = i[some], j[some], expected[some]
        if not len(i):
            return
        names, column = np.unique(p[2], return_inverse=True)
        theirs = np.minimum(np.searchsorted(names, q[2]), len(names) - 1)
        theirs[names[theirs] != q[2]] = len(names)
        step = max(1, MARKS // (len(names) + 1))
        for r in range(i[0], i[-1] + 1, step):  # pairs go by i
            marks = np.zeros((step, len(names) + 1), bool)
            own = slice(p[1][r], p[1][min(r + step, len(p[0]))])
            marks[row[own] - r, column[own]] = True
            here = np.arange(*np.searchsorted(i, (r, r + step)))
            size = q[1][j[here] + 1] - q[1][j[here]]
            upto = np.cumsum(size)
            for c in np.split(np.arange(len(here)), np.searchsorted(upto, np.arange(nb.ROWS, upto[-1], nb.ROWS))) if len(here) else []:
                if not len(c):
                    continue
                x, n = here[c], size[c]
                first = np.cumsum(n) - n
                at = np.arange(n.sum()) + np.repeat(q[1][j[x]] - first, n)
                common = np.add.reduceat(marks[np.repeat(i[x] - r, n), theirs[at]] * q[3][at], first)
                link = x[(common > expected[x]) & (common >= min_shared)]
                yield p[0][i[link]], q[0][j[link]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                p, q = (unpacked(batch.column(side)[k].values) for side in ("left", "right"))
                same = batch.column("x")[k].as_py() == batch.column("y")[k].as_py()
                for one, two in ((p, q),) if same else ((p, q), (q, p)):
                    for i, j in found(one, two):
                        given = {key: pa.array([batch.column(key)[k].as_py()] * len(i), batch.column(key).type) for key in keys}
                        yield pa.record_batch(given | {"i": i, "j": j})

    return run


def class_links(neighbors: DataFrame, share: float, min_shared: int = 0, sqrt: bool = False) -> tuple[DataFrame, DataFrame]:
    """``links`` (i, j) between classes of equal tips, and (rep) of the classes whose own tips are linked with each other.

    ``neighbors`` (a, b, size) are written rows between classes, each with itself; equal tips have the same list.
    """
    n = neighbors.groupBy("a").agg(F.sum("size").alias("n"))
    own = n.where((F.col("n") >= min_shared) & (F.col("n") > share * F.col("n"))).select(F.col("a").alias("rep"))
    return links(neighbors, share, None, min_shared, sqrt), own


def spread_links(link: DataFrame, own: DataFrame, members: DataFrame) -> DataFrame:
    """(i, j): the links i < j of all tips (members: tip_id, rep) from ``class_links``."""
    pairs = link.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(own.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    every = nb.expanded(pairs.withColumn("same", F.col("a") == F.col("b")), members)
    return every.where("NOT same OR a < b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def spread_components(link: DataFrame, own: DataFrame, members: DataFrame) -> DataFrame:
    """(tip_id, component) of all tips (members: tip_id, rep) from ``class_links``; a class has the id of its least tip."""
    found = components(link, own.select(F.col("rep").alias("tip_id")).unionByName(link.select(F.col("i").alias("tip_id"))).unionByName(link.select(F.col("j").alias("tip_id"))))
    return members.join(found.withColumnRenamed("tip_id", "rep"), "rep", "left").select("tip_id", F.coalesce("component", "tip_id").alias("component"))


def components(link: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip_id, component) for all tips: the least tip that links lead to."""
    found = connected_components(link, "i", "j").withColumnRenamed("node", "tip_id")
    return tips.select("tip_id").distinct().join(found, "tip_id", "left").select("tip_id", F.coalesce("component", "tip_id").alias("component"))


def regular_ids(members: DataFrame, min_size: int = 1, column: str = "component") -> DataFrame:
    """(tip_id, cluster_id): 1.. by falling size, ties by first tip; clusters under ``min_size`` become 0.

    Ranks are places in range partitions, so that no task has all clusters.
    """
    sizes = members.groupBy(column).agg(F.count("*").alias("n"), F.min("tip_id").alias("first")).where(F.col("n") >= min_size)
    ranked = numbered(sizes.withColumn("order", -F.col("n")), ["order", "first"], "place").withColumn("cluster_id", F.col("place") + 1)
    return members.join(ranked.select(column, "cluster_id"), column, "left").select("tip_id", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


def nested(clusters: DataFrame, members: DataFrame, layer: int) -> DataFrame:
    """``clusters`` with one more layer: ``members`` (tip_id, cluster_id) within the clusters of ``layer``; ids go on
    after the greatest so far."""
    top = clusters.agg(F.coalesce(F.max("cluster_id"), F.lit(0)).alias("top"))
    new = members.crossJoin(F.broadcast(top)).select("tip_id", F.lit(layer + 1).alias("layer"), F.when(F.col("cluster_id") > 0, F.col("cluster_id") + F.col("top")).otherwise(0).alias("cluster_id"))
    return clusters.select("tip_id", "layer", "cluster_id").unionByName(new)


def backbone(clusters: DataFrame) -> DataFrame:
    """(layer, n_clusters, n_single, backbone, largest): backbone = clusters + tips without one."""
    per = clusters.groupBy("layer", "cluster_id").agg(F.count("*").alias("n"))
    out = per.groupBy("layer").agg(F.count(F.when(F.col("cluster_id") > 0, 1)).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("cluster_id") == 0, F.col("n"))), F.lit(0)).alias("n_single"), F.coalesce(F.max(F.when(F.col("cluster_id") > 0, F.col("n"))), F.lit(0)).alias("largest"))
    return out.select("layer", "n_clusters", "n_single", (F.col("n_clusters") + F.col("n_single")).alias("backbone"), "largest")


def resplit(clusters: DataFrame, cluster_id: int, members: DataFrame) -> DataFrame:
    """``clusters`` with one cluster split further: its tips get the ids of ``members`` (tip_id, cluster_id), counted on
    from the greatest so far, in the layer below it, which is made (0 for all others) if it isn't there yet."""
    top = clusters.agg(F.max("cluster_id").alias("top"), F.max("layer").alias("deepest"), F.max(F.when(F.col("cluster_id") == cluster_id, F.col("layer"))).alias("own")).first()
    new = members.select("tip_id", F.when(F.col("cluster_id") > 0, F.col("cluster_id") + top.top).otherwise(0).alias("new"))
    if top.own == top.deepest:
        clusters = clusters.unionByName(clusters.select("tip_id").distinct().select("tip_id", F.lit(top.own + 1).alias("layer"), F.lit(0).cast("long").alias("cluster_id")))
    inside = clusters.where((F.col("layer") == top.own) & (F.col("cluster_id") == cluster_id)).select("tip_id").join(new, "tip_id").withColumn("layer", F.lit(top.own + 1))
    return clusters.join(inside, ["tip_id", "layer"], "left").select("tip_id", "layer", F.coalesce("new", "cluster_id").alias("cluster_id"))


def advice(quality: DataFrame, ratio: float = 1.2, most_backbone: int = 0, most_members: int = 0) -> DataFrame:
    """Adds ``step`` (0 stop, -1 lower the radius, 1 raise it), ``valid`` and ``balance``, the mean of both sizes.

    A split is good if backbone and largest cluster are within ``ratio`` of each other and one of the given bounds (0:
    none) holds, or none is given. Else the larger of the two should shrink; a bound that is broken decides first,
    the backbone's before the cluster's, and makes the split invalid.
    """
    top, low = F.col("backbone"), F.col("largest")
    alike = (top <= ratio * low) & (low <= ratio * top)
    held = F.lit(most_backbone == 0 and most_members == 0) | (F.lit(most_backbone > 0) & (top <= most_backbone)) | (F.lit(most_members > 0) & (low <= most_members))
    over_top, over_low = F.lit(most_backbone > 0) & (top > most_backbone), F.lit(most_members > 0) & (low > most_members)
    step: Column = F.when(alike & held, 0).when(over_top, -1).when(over_low, 1).when(top >= low, -1).otherwise(1)
    return quality.withColumn("step", step).withColumn("valid", (alike & held) | ~(over_top | over_low)).withColumn("balance", (top + low) / 2)


def summary(clusters: DataFrame, layer: int) -> DataFrame:
    """(cluster_id, n_tips, n_children, n_single, n_pseudo) of a layer: distinct clusters of the next layer plus
    members without one make up a cluster's pseudo-tips."""
    low = clusters.where(F.col("layer") == layer).select("tip_id", "cluster_id")
    child = clusters.where(F.col("layer") == layer + 1).select("tip_id", F.col("cluster_id").alias("child"))
    out = low.join(child, "tip_id", "left").fillna(0, ["child"]).groupBy("cluster_id").agg(
        F.count("*").alias("n_tips"), F.countDistinct(F.when(F.col("child") > 0, F.col("child"))).alias("n_children"), F.count(F.when(F.col("child") == 0, 1)).alias("n_single"))
    return out.withColumn("n_pseudo", F.col("n_children") + F.col("n_single"))


def pseudo_sizes(members: DataFrame) -> DataFrame:
    """(pseudo, size): summed tip sizes of each pseudo-tip, from (pseudo, size) rows."""
    return members.groupBy("pseudo").agg(F.sum("size").alias("size"))
