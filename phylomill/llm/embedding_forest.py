"""Operator 11: near-duplicate vectors by a forest of random-projection trees.

Two vectors of equal label and length are linked if their cosine, in double precision, is ``THRESHOLD`` or more. Each
tree halves the vectors again and again at quantiles of a random projection; what lies between the quantiles 0.5 -
``SPILL`` / 2 and 0.5 + ``SPILL`` / 2 goes to both sides. Vectors that share a leaf and a label, a *cell*, are compared;
links of all trees are united. A pair of cells' common members is counted in the least cell that both are in, so no list
of pairs is ever made.

The first trees are fitted on a bounded sample (``SAMPLE_BYTES``) and index every row; a cell of more than ``MOST``
vectors gets a tree of its own, from a sample of its own, until none is left. A cell in which a good part of the sampled
pairs is linked isn't split, as a split would part them: it is compared block by block in as many tasks as it takes.
Very large groups of near copies are seen in the sample and set apart as *balls*, all within half the angle of a centre:
their members are all linked, so a count is enough for them. Equal vectors are one vector with a weight.

Defined cases: a vector that is null, empty or zero, or has a null or non-finite component, or a null label, links with
nothing, and is its own component; repeated rows are vectors of their own, linked with each other; a row without a
vec_id links with nothing and is kept with a null component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomill.llm import textscan as ts
from phylomill.operators.components import connected_components
from phylomill.stash import stash

THRESHOLD = 0.93
TREES, SPILL = 10, 0.1
LEAF, MOST = 512, 2_048  # vectors of a label where a tree stops, and that are compared in one task
SAMPLE_BYTES = 8 << 20  # of doubles that the first trees, or a cell's own, are fitted on
TIGHT = 0.25  # share of linked pairs from which a cell isn't split
LEAST_FIT = 32  # sampled vectors that a split or a ball needs
PORTION = 20_000  # trees of cells that go to all executors at once (under 100 MB)
SEED = 11

_CLASS = "node long, k1 long, k2 long, label long, w long"


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, offsets and whether each vector can link."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, off = column.flatten(), np.append(0, np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)))
    x = flat.to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    some = np.append(0, np.cumsum(x != 0))
    return x, off, (bad[off[1:]] == bad[off[:-1]]) & (some[off[1:]] > some[off[:-1]])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision, however large or small their components are."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, off, ok = _vectors(batch.column("v"))
        label = batch.column("label")
        for c in ("label", "vec_id"):
            ok &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
        x = x + x.dtype.type(0)  # one zero
        key = [xxhash.xxh3_128_intdigest(x[a:b].tobytes(), c or 0) if y else 0 for a, b, c, y in zip(off[:-1].tolist(), off[1:].tolist(), ((label.cast(pa.int64()).fill_null(0).to_numpy() & (2**63 - 1)).tolist()), ok.tolist())]
        yield pa.record_batch({
            "vec_id": batch.column("vec_id"), "label": label, "v": batch.column("v"), "ok": ok,
            "k1": np.array([k >> 64 for k in key], np.uint64).view(np.int64), "k2": np.array([k & (2**64 - 1) for k in key], np.uint64).view(np.int64),
        })


def _number(*parts: np.ndarray | int) -> np.ndarray:
    h = np.array([SEED], np.uint64)
    for p in parts:
        h = ts.mix(np.asarray(p).astype(np.int64).view(np.uint64) + ts.mix(h + np.uint64(0x9E3779B97F4A7C15)))
    return h


def _direction(seed: int, level: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([SEED, seed & (2**63 - 1), level, dim]).standard_normal(dim)
    return d / np.sqrt((d * d).sum())


class Tree:
    """Splits in order of their levels; ``child`` is negative at a leaf."""

    def __init__(self, seed: int, low: list[float], high: list[float], child: list[int]):
        self.seed, self.low, self.high, self.child = seed, np.array(low), np.array(high), np.array(child, np.int64)

    @staticmethod
    def fitted(x: np.ndarray, label: np.ndarray, seed: int, scale: float, leaf: int) -> Tree:
        """``scale``: vectors for each sampled one. A node is split while one label has over ``leaf`` vectors in it."""
        low, high, child = [0.0], [0.0], [-1]
        level, todo = 0, [(0, np.arange(len(x)))]
        while todo:
            p, below = x @ _direction(seed, level, x.shape[1]), []
            for node, rows in todo:
                most = np.unique(label[rows], return_counts=True)[1].max(initial=0)
                if most * scale <= leaf or most < LEAST_FIT:
                    continue
                q = p[rows]
                a, b = np.quantile(q, (0.5 - SPILL / 2, 0.5 + SPILL / 2))
                left, right = rows[q <= b], rows[q >= a]
                if max(len(left), len(right)) > 0.9 * len(rows):  # ties
                    continue
                low[node], high[node], child[node] = a, b, len(child)
                for side in (left, right):
                    below.append((len(child), side))
                    low.append(0.0), high.append(0.0), child.append(-1)
            level, todo = level + 1, below
        return Tree(seed, low, high, child)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that each row of ``x`` goes to."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, found, level = [], [], 0
        while len(row):
            end = self.child[node] < 0
            rows.append(row[end]), found.append(node[end])
            row, node = row[~end], node[~end]
            p = (x @ _direction(self.seed, level, x.shape[1]))[row] if len(row) else np.zeros(0)
            left, right = p <= self.high[node], p >= self.low[node]
            row, node, level = np.concatenate((row[left], row[right])), np.concatenate((self.child[node[left]], self.child[node[right]] + 1)), level + 1
        return np.concatenate(rows), np.concatenate(found)


def balls(x: np.ndarray, label: np.ndarray, scale: float, leaf: int, threshold: float = THRESHOLD) -> list[tuple[int, np.ndarray]]:
    """(label, centre) of balls with over ``leaf`` vectors by the sample; of several that hold a vector the first counts."""
    half, out, need = half_angle(threshold), [], max(LEAST_FIT, leaf / scale)
    for c, n in zip(*np.unique(label, return_counts=True)):
        if n < need:
            continue
        mine = x[label == c]
        near = (mine @ mine[:512].T) >= threshold
        while len(mine) >= need:
            sums = near.sum(axis=0)
            j = int(sums.argmax()) if len(sums) else 0
            if not len(sums) or sums[j] < need:
                break
            centre = mine[near[:, j]].sum(axis=0)
            centre /= np.sqrt(centre @ centre)
            inside = mine @ centre >= half
            if inside.sum() >= need:
                out.append((int(c), centre))
            gone = inside | near[:, j]
            keep = np.flatnonzero(sums - near[gone].sum(axis=0) >= need)
            mine, near = mine[~gone], near[~gone][:, keep]
    return out


def half_angle(threshold: float) -> float:
    """The cosine of half the angle of ``threshold``, a little more: two vectors so close to a third are linked."""
    return float(np.sqrt((1 + threshold) / 2) + 1e-9)


def _routed(trees: list[Tree], found: list[tuple[int, np.ndarray]], dim: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, off, _ = _vectors(batch.column("v"))
            label, size = batch.column("label").to_numpy(), np.diff(off)
            main = np.flatnonzero(size == dim)
            u = unit(x[(off[main][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)) if len(main) else np.zeros((0, dim))
            ball = np.full(len(size), -1, np.int32)
            for k, (c, centre) in reversed(list(enumerate(found))):
                at = main[(label[main] == c) & (u @ centre >= half_angle(threshold))]
                ball[at] = k
            rest = np.flatnonzero(size != dim)
            rows, cells = [rest], [_number(label[rest], size[rest], -1)]
            for t, tree in enumerate(trees):
                row, leaf = tree.leaves(u)
                row = main[row]
                rows.append(row), cells.append(_number(label[row], dim, t, leaf))
            yield pa.record_batch([*(batch.column(c) for c in ("node", "k1", "k2", "label", "w", "v")), pa.array(ball), _lists(np.concatenate(rows), np.concatenate(cells), len(size))], names=["node", "k1", "k2", "label", "w", "v", "ball", "cells"])

    return run


def _lists(row: np.ndarray, cell: np.ndarray, n: int) -> pa.ListArray:
    o = np.argsort(row, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))), pa.int32()), pa.array(cell[o].view(np.int64)))


def _own_tree(threshold: float, leaf: int):
    """A tree for a cell from its sample, or none if the cell is tight."""

    def run(table: pa.Table) -> pa.Table:
        x, off, _ = _vectors(table.column("v"))
        u = unit(x.reshape(len(off) - 1, -1))
        some, ball = u[:256], table.column("ball").to_numpy()[:256]
        near = (some @ some.T >= threshold) & ~((ball[:, None] == ball) & (ball >= 0))
        cell, scale = table.column("cell")[0].as_py(), table.column("scale")[0].as_py()
        low, high, child = [], [], []
        if near.sum() - np.diag(near).sum() < TIGHT * len(some) * (len(some) - 1):
            tree = Tree.fitted(u, np.zeros(len(u), np.int64), cell, scale, leaf)
            low, high, child = tree.low.tolist(), tree.high.tolist(), tree.child.tolist()
        return pa.table({"cell": pa.array([cell], pa.int64()), "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64())), "child": pa.array([child], pa.list_(pa.int64()))})

    return run


def _replaced(trees: dict[int, Tree]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells that have a tree of their own become that tree's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, off, _ = _vectors(batch.column("v"))
            lists = batch.column("cells")
            cell, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(off) - 1), lists.value_lengths().to_numpy())
            o = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[o], prepend=cell[o][:1] - 1)) if len(o) else o
            rows, cells = [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(o)]):
                mine, c = row[o[a:b]], int(cell[o[a]])
                if c in trees:
                    dim = off[mine[0] + 1] - off[mine[0]]
                    at, leaf = trees[c].leaves(unit(x[(off[mine][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)))
                    rows.append(mine[at]), cells.append(_number(c, leaf))
                else:
                    rows.append(mine), cells.append(np.full(len(mine), c).view(np.uint64))
            new = _lists(np.concatenate(rows), np.concatenate(cells), len(off) - 1) if rows else lists
            yield batch.set_column(batch.schema.get_field_index("cells"), "cells", new)

    return run


def _split(routed: DataFrame, threshold: float, leaf: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Cells of at most ``most`` vectors, but for those in (cell, blocks), which are tight."""
    tight = None
    members = lambda r: r.select(F.explode("cells").alias("cell"), "v", "k1", "ball")
    while True:
        size = members(routed).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = stash(size if tight is None else size.join(tight, "cell", "left_anti"), "large-cells")
        if large.isEmpty():
            return routed, tight
        fit = max(2 * LEAST_FIT, min(4_096, SAMPLE_BYTES // (8 * max(1, routed.select(F.max(F.size("v"))).first()[0]))))
        drawn = members(routed).join(large, "cell").where(F.pmod(F.xxhash64("k1", "cell"), F.lit(1 << 30)) < F.lit(float(fit << 30)) / F.col("n"))
        drawn = drawn.select("cell", "v", "ball", F.greatest(F.lit(1.0), F.col("n") / fit).alias("scale"))
        own = stash(drawn.groupBy("cell").applyInArrow(_own_tree(threshold, leaf), "cell long, low array<double>, high array<double>, child array<long>"), "own-trees")
        # a cell without a split is tight, or its vectors are the same but for rounding
        done = own.where(F.size("child") < 2).join(large, "cell").select("cell", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
        tight = stash(done if tight is None else tight.unionByName(done), "tight-cells")
        portion: dict[int, Tree] = {}
        for r in own.where(F.size("child") > 1).toLocalIterator():
            portion[r.cell] = Tree(r.cell, r.low, r.high, r.child)
            if len(portion) == PORTION:
                routed, portion = stash(routed.mapInArrow(_replaced(portion), routed.schema), "routed"), {}
        if portion:
            routed = stash(routed.mapInArrow(_replaced(portion), routed.schema), "routed")


def _compared(threshold: float):
    """(node, k1, k2, links, low) of the vectors of a cell, or of two of its blocks, that link there: links of pairs that
    share no lesser cell and no ball, and the least node that the links of the cell reach."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        x, off, _ = _vectors(table.column("v"))
        u = unit(x.reshape(n, -1))
        node, w, ball, block = (table.column(c).to_numpy() for c in ("node", "w", "ball", "b"))
        cell = table.column("cell")[0].as_py()
        lists = table.column("cells").combine_chunks()
        size = lists.value_lengths().to_numpy()
        cells = np.full((n, size.max()), np.iinfo(np.int64).max)
        cells[np.arange(cells.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
        cells[cells >= cell] = np.iinfo(np.int64).max  # only lesser cells matter
        cells = np.sort(cells, axis=1)
        cells = cells[:, : max(1, int((cells < cell).sum(axis=1).max()))]
        two = block.min() != block.max()
        pairs_a, pairs_b = [], []
        for i in range(0, n, 256):
            a, b = np.nonzero(u[i : i + 256] @ u[i:].T >= threshold)
            ok = a < b
            a, b = a[ok] + i, b[ok] + i
            ok = ~((ball[a] == ball[b]) & (ball[a] >= 0))
            if two:
                ok &= block[a] != block[b]
            pairs_a.append(a[ok]), pairs_b.append(b[ok])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        links = np.zeros(n, np.int64)
        for i in range(0, len(a), 16_384):
            p, q = a[i : i + 16_384], b[i : i + 16_384]
            mine, theirs = cells[p], cells[q]
            seen = np.zeros(len(p), bool)
            for k in range(mine.shape[1]):
                seen |= ((theirs == mine[:, k, None]) & (mine[:, k, None] < cell)).any(axis=1)
            np.add.at(links, p[~seen], w[q[~seen]])
            np.add.at(links, q[~seen], w[p[~seen]])
        low = node.copy()
        while len(a):
            least, was = np.minimum(low[a], low[b]), low.copy()
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
            if (low == was).all():
                break
        at = np.flatnonzero((links > 0) | (low != node))
        return pa.table([table.column("node").take(at), table.column("k1").take(at), table.column("k2").take(at), pa.array(links[at]), pa.array(low[at])], names=["node", "k1", "k2", "links", "low"])

    return run


def components(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, most: int = MOST, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    rows = stash(given.mapInArrow(_keyed, f"vec_id long, label long, v array<{kind}>, ok boolean, k1 long, k2 long"), "vectors")
    able = rows.where("ok")
    classes = stash(able.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.first("label").alias("label"), F.count("*").alias("w"), F.first("v").alias("v")), "classes")
    total, widest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(4 * LEAST_FIT, sample_bytes // (8 * (widest or 1)))
    rate = min(1.0, size / max(1, total))
    # the sample is bounded by its rate; it fits the trees and balls, which index every row
    sample = classes.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("k1", "label", "v").toArrow().sort_by("k1")
    lengths = sample.column("v").combine_chunks().value_lengths().to_numpy() if sample.num_rows else np.zeros(0, np.int64)
    dim = int(np.bincount(lengths).argmax()) if len(lengths) else widest or 1
    sample = sample.filter(pa.array(lengths == dim))
    x = unit(_vectors(sample.column("v"))[0].reshape(-1, dim)) if sample.num_rows else np.zeros((0, dim))
    label = sample.column("label").to_numpy()
    found = balls(x, label, 1 / rate, leaf, threshold)
    forest = [Tree.fitted(x, label, t, 1 / rate, leaf) for t in range(trees)]
    shape = f"{_CLASS}, v array<{kind}>, ball int, cells array<long>"
    routed = stash(classes.select("node", "k1", "k2", "label", "w", "v").mapInArrow(_routed(forest, found, dim, threshold), shape), "routed")
    routed, tight = _split(routed, threshold, leaf, most)
    member = routed.select("node", "k1", "k2", "w", "v", "ball", "cells", F.explode("cells").alias("cell"))
    if tight is None:
        member = member.withColumns({"b": F.lit(0), "x": F.lit(0), "y": F.lit(0)})
    else:
        member = stash(member, "members").join(tight, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        member = member.withColumn("b", F.pmod(F.xxhash64("k2", "cell"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        member = member.select("node", "k1", "k2", "w", "v", "ball", "cells", "cell", "b", F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"))
    links = stash(member.groupBy("cell", "x", "y").applyInArrow(_compared(threshold), "node long, k1 long, k2 long, links long, low long"), "links")
    whole = routed.where("ball >= 0").groupBy("ball").agg(F.sum("w").alias("all"), F.min("node").alias("least"))
    whole = F.broadcast(whole)  # a row for each ball, of which a sample of bounded size has only so many
    balled = stash(routed.select("node", "k1", "k2", "w", "ball").join(whole, "ball", "left"), "balled")
    edges = links.select("node", "low").unionByName(balled.where("ball >= 0").select("node", F.col("least").alias("low"))).where("node != low").distinct()
    label_of = stash(connected_components(edges, "node", "low").withColumnRenamed("node", "n0"), "labels")
    counts = links.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    per_class = balled.join(counts, ["k1", "k2"], "left").join(label_of, F.col("node") == F.col("n0"), "left")
    n = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("all") - F.col("w"), F.lit(0)) + F.col("w") - 1
    per_class = stash(per_class.select("k1", "k2", n.alias("n_links"), F.coalesce("component", "node").alias("component_id")), "linked")
    out = able.select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
