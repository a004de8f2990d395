"""Operator 6: near-duplicate groups by MinHash, banding, verification and connected components.

A document is the set of its distinct word shingles; two are linked if the Jaccard similarity of the full sets is at
least ``THRESHOLD`` percent. ``BANDS`` bands of ``ROWS`` universal-hash minima miss a pair at exactly 0.8 with
probability (1 - 0.8**6)**42 < 3e-6, and pairs of 0.85 with 3e-9.

Equal sets are one node from the start, so groups of exact copies cost one row each. Within a bucket no pairs are
enumerated: every member meets the bucket's first, and what is verified is joined into components. Where a bucket
then still holds several components, its documents go through an exact prefix filter across components.

Defined cases: a null, empty or wordless text has no shingles and no links; a text with fewer words than a shingle
is one shingle; copies link at any length; repeated rows share doc_id and component;
a row without a doc_id has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomill.llm import textscan as ts
from phylomill.llm.repeats import named
from phylomill.operators.components import connected_components
from phylomill.stash import stash

ROWS, BANDS = 6, 42
THRESHOLD = 80
LEAST_ESTIMATE = 0.65  # of 252 minima; six standard errors under 0.8
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document in a slice."""
    words = ts.Words(data, offsets, lower=True)
    h = words.hashes()
    grams = ts.gram_hash(h, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(ts.gram_hash(h[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.utf8(batch.column("text"))
            for i, j in ts.slices(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                sizes = np.array([len(s) for s in sets], np.int64)
                has = np.flatnonzero(sizes)
                minima = np.zeros((len(_A), len(has)), np.uint64)
                if len(has):
                    flat, at = np.concatenate(sets), (np.cumsum(sizes) - sizes)[has]
                    for f in range(len(_A)):
                        minima[f] = np.minimum.reduceat(flat * _A[f] + _B[f], at)
                bands = np.zeros((len(has), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = bands * np.uint64(0xD6E8FEB86659FD93) + minima[r::ROWS].T
                bands = ts.mix(bands + np.arange(BANDS, dtype=np.uint64))
                signature = (ts.mix(minima) >> np.uint64(56)).astype(np.uint8).T  # minima are small numbers; mixed, their top bytes differ
                count = np.zeros(len(sets) + 1, np.int32)
                count[has + 1] = BANDS
                key = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                at = dict(zip(has.tolist(), range(len(has))))
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(i, j - i),
                    "n_shingles": sizes,
                    "k1": np.array([k >> 64 for k in key], np.uint64).view(np.int64),
                    "k2": np.array([k & (2**64 - 1) for k in key], np.uint64).view(np.int64),
                    "bands": pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), pa.array(bands.ravel().view(np.int64))),
                    "signature": pa.array([signature[at[x]].tobytes() if x in at else b"" for x in range(len(sets))], pa.binary()),
                })

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.utf8(batch.column("text"))
            for i, j in ts.slices(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                at = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "shingles": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))})

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in LEAST_ESTIMATE of their minima."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(len(batch), -1) for x in ("sa", "sb"))
            batch = batch.filter(pa.array((a == b).mean(axis=1) >= LEAST_ESTIMATE))
        yield batch.select(["a", "b", "na", "nb"])


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are linked, judged by size, signature and then the full sets."""
    side = lambda x: nodes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(na, nb) >= %d * greatest(na, nb)" % threshold)
    near = stash(near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_alike, "a long, b long, na long, nb long"), "pairs")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))
    return near.join(side("a"), "a").join(side("b"), "b").withColumn("common", common).where(100 * F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    sketch = stash(named(docs).mapInArrow(_sketch(width), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, signature binary"), "sketch")
    same = sketch.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    same = stash(same, "same")
    member = stash(sketch.join(same, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node")), "member")
    nodes = stash(sketch.where("n_shingles > 0").join(same.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "signature"), "nodes")
    buckets = nodes.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    crowd = buckets.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("c > 1").drop("c")
    crowd = stash(crowd, "crowd")  # so that the join can split the rows of a very common bucket
    buckets = stash(buckets.join(crowd, "key"), "buckets")
    # the full sets of all documents that share a bucket, made once for every later step
    shared = buckets.select("doc_id").distinct()
    sets = stash(named(docs).join(shared, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(width), "doc_id long, shingles array<long>"), "sets")
    meet = buckets.where("low != doc_id").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = stash(verified(meet, nodes, sets, threshold), "links")
    label = stash(connected_components(links, "a", "b"), "labels")
    placed = buckets.join(label, buckets.doc_id == label.node, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    split = stash(split, "split")
    left = stash(placed.join(split, "key").select("doc_id", "component").distinct(), "apart")
    new = stash(verified(_prefix_pairs(left, sets, threshold), nodes, sets, threshold), "links")
    if not new.isEmpty():
        label = stash(connected_components(links.unionByName(new), "a", "b"), "labels")
    out = member.join(label.withColumnRenamed("node", "n0"), F.col("node") == F.col("n0"), "left")
    component = F.coalesce("component", "node")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    nameless = docs.where("doc_id IS NULL").select("doc_id", "text").mapInArrow(_sets(width), "doc_id long, shingles array<long>")
    return out.unionByName(nameless.select("doc_id", F.size("shingles").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def _prefix_pairs(left: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of documents in different components that can still be linked, none left out.

    Prefix filter: shingles are ordered by how many of these documents have them, rarest first. Two sets that reach
    the threshold share one among the first n - ceil(t * n) + 1 of either, and from their first common one on there
    is enough left on both sides. So copies of one text that differ too much don't meet by what all copies share.
    A shingle's largest component isn't joined with itself.
    """
    sets = sets.join(left.select("doc_id"), "doc_id", "left_semi")
    df = stash(sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "df")
    rows = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(df, "s", "left")
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s")))
    first = F.slice(F.col("rare"), F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1).cast("int"))
    rows = rows.groupBy("doc_id", "n").agg(rare.alias("rare")).select("doc_id", "n", F.posexplode(first).alias("i", "x"))
    rows = rows.where("x.df > 1").select("doc_id", "n", "i", F.col("x.s").alias("s")).join(left, "doc_id")
    rows = stash(rows, "prefixes")
    sizes = rows.groupBy("s", "component").agg(F.count("*").alias("m"))
    large = stash(sizes.groupBy("s").agg(F.max(F.struct("m", "component")).alias("l"), F.count("*").alias("c")).where("c > 1").select("s", F.col("l.component").alias("large")), "large")
    rows = stash(rows.join(large, "s"), "prefixes")
    other = rows.select("s", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "component", "n", "i")])
    need = f"100 * least(n - i, n_b - i_b) * {100 + threshold} >= 100 * {threshold} * (n + n_b)"
    met = rows.where("component != large").join(other, "s").where(f"component != component_b AND (component_b = large OR doc_id < doc_id_b) AND {need}")
    return met.select(F.least("doc_id", "doc_id_b").alias("a"), F.greatest("doc_id", "doc_id_b").alias("b")).distinct()


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
