"""Operator 13: importance resampling towards a target distribution, on hashed n-gram features.

A feature is a run of 1 to ``order`` consecutive words; its bucket is its CRC-32 modulo ``BUCKETS``. A bucket's gain is
the scaled log ratio of its smoothed shares in the target and in the corpus, a document's weight the floored mean of the
gains of its features, and its score the weight plus Gumbel noise that hangs on its doc_id alone: the highest scores are
a draw without replacement in proportion to exp(weight / 1000).

Texts go through Arrow kernels a slice of a batch at a time: ascii_lower, split_pattern_regex, list_flatten and
dictionary_encode. N-grams are pairs of a shorter one's index and the dictionary index shifted by its length; a CRC is
taken once for each distinct pair, gains are taken by index and summed by segments. A task sends one row for each bucket
that it has seen. Bucket counts (``BUCKETS`` rows) and the counts of scores (logarithms of 64-bit counts times a thousand,
so under 150,000 distinct values) are all that the driver ever holds.

Defined cases: a null, empty or wordless text has no feature and weight 0, and its score is noise; it is never drawn
where ``least`` is 1 or more. A row without a doc_id has a weight, but no score. Rows of one doc_id are one document in
the draw: its best score counts, and all its rows with that score get the rank. An empty target gives gains that follow
the corpus alone; an empty corpus gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phylomill.llm import textscan as ts
from phylomill.llm.repeats import unused
from phylomill.stash import stash

BUCKETS = 10_000
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after lower-casing
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10


def features(texts: pa.Array, order: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of ``texts``, and the number of words of each row."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SPLIT)
    encoded = pc.list_flatten(lists).dictionary_encode()
    words = [w.encode() for w in encoded.dictionary.to_pylist()]
    index, row = encoded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
    solid = np.array([len(w) > 0 for w in words], bool)[index] if words else np.zeros(0, bool)
    index, row = index[solid].astype(np.int64), row[solid]
    crc = np.array([zlib.crc32(w) for w in words], np.uint64)
    rows, found = [row], [crc[index] if len(index) else np.zeros(0, np.uint64)]
    gram, sums = index, crc.tolist()
    for k in range(1, order):
        if len(index) <= k:
            break
        pair = gram[: len(index) - k] * len(words) + index[k:]
        distinct, gram = np.unique(pair, return_inverse=True)
        sums = [zlib.crc32(b" " + words[b], sums[a]) for a, b in zip((distinct // len(words)).tolist(), (distinct % len(words)).tolist())]
        inside = row[: len(index) - k] == row[k:]
        rows.append(row[: len(index) - k][inside])
        found.append(np.array(sums, np.uint64)[gram[inside]])
    bucket = np.concatenate(found) % np.uint64(buckets)
    return np.concatenate(rows), bucket.astype(np.int64), np.bincount(row, minlength=len(texts))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts, a null one as empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        for i, j in ts.slices(ts.utf8(texts)[1]):
            yield batch.slice(i, j - i), texts.slice(i, j - i)


def bucket_counts(docs: DataFrame, order: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _pieces(batches):
            total += np.bincount(features(texts, order, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the smoothed corpus share, for each bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def _weigh(gain: np.ndarray, order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pieces(batches):
            row, bucket, words = features(texts, order, len(gain))
            o = np.argsort(row, kind="stable")
            row, each = row[o], gain[bucket[o]]
            n, total = np.bincount(row, minlength=len(texts)), np.zeros(len(texts), np.int64)
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[first]] = np.add.reduceat(each, first)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": words, "n_features": n, "weight": total // np.maximum(n, 1)})

    return run


def weights(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of ``docs``."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_weigh(gain, order), "doc_id long, n_words long, n_features long, weight long")


def scored(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Plus ``score``: the weight with the doc_id's Gumbel noise, from 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + noise)


def draw(weighted: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): floor(percent * N / 100) of the N documents with ``least``
    words or more are drawn, highest score first and then the smaller doc_id; rank is null for all others.

    Ranks are positions within one score plus a count of higher scores, so that no task orders the whole draw.
    """
    rows = stash(scored(weighted, seed), "scored")
    docs = rows.where((F.col("n_words") >= least) & F.col("score").isNotNull()).groupBy("doc_id").agg(F.max("score").alias("score"))
    docs = stash(docs, "candidates")
    counts = sorted(((r.score, r.n) for r in docs.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    want, above, before = percent * sum(n for _, n in counts) // 100, 0, []
    for score, n in counts:
        if above >= want:
            break
        before.append((score, above))
        above += n
    spark = rows.sparkSession
    offsets = spark.createDataFrame(pa.table({"score": pa.array([b[0] for b in before], pa.int64()), "above": pa.array([b[1] for b in before], pa.int64())}))
    place = F.row_number().over(W.partitionBy("score").orderBy("doc_id")) + F.col("above")
    ranks = docs.join(F.broadcast(offsets), "score").select(F.col("doc_id").alias("id"), F.col("score").alias("best"), place.cast("long").alias("rank")).where(F.col("rank") <= want)
    out = rows.join(ranks, (F.col("doc_id") == F.col("id")) & (F.col("score") == F.col("best")) & (F.col("n_words") >= least), "left")
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, order: int = 1, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn documents with all of their columns."""
    drawn = draw(weights(docs, target, order), percent, least, seed).where("rank IS NOT NULL").select("doc_id").distinct()
    name = unused(docs, "drawn_id")
    return docs.join(drawn.withColumnRenamed("doc_id", name), F.col("doc_id").cast("long") == F.col(name), "left_semi")


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return draw(weights(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")
