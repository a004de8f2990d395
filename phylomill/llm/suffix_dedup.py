"""Operator 2: exact substring dedup by suffix sorting with bucket-pointer refinement.

Every byte that is covered by a ``length``-byte string which also starts anywhere else is removed. Suffixes are
sorted no deeper than ``length``. The initial buckets are q-grams; a bucket is refined by sorting its suffixes on
the bucket identifiers found q bytes later, and the refined identifiers serve the next, twice as deep, refinement.

A suffix array of the whole corpus fits nowhere, so the suffixes that can't share ``length`` bytes with another are
set aside first (see ``repeats``): Spark groups segments by the hash of their anchor, and a suffix array is built
for blocks of whole anchor classes. Bytes are compared through 64-bit hashes of two independent kinds. An anchor class
is itself a q-gram bucket; one with more than ``MOST`` distinct segments is refined by the q-grams at later offsets
before it is sorted, so that no task holds more than a block and ``MOST`` segments.

Defined cases: a row without a doc_id is left alone; a null or empty text has no bytes; a document shorter than ``length`` keeps all; equal documents
lose all of their bytes when long enough, the first included. A doc_id names one text; repeated rows are copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomill.llm import repeats
from phylomill.llm import textscan as ts

BLOCK = 2_000_000  # suffixes that one suffix array holds; a block ends with a class
MOST = 2_500  # distinct segments of a class, of at most 2 * length bytes each


def _gram_width(length: int) -> int:
    return max(1, length // 6)


def _segments(length: int, levels: list):
    k = _gram_width(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in ts.slices(off):
                buf, first = data[off[i] : off[j]], off[i : j + 1] - off[i]
                if len(buf) < length:
                    continue
                c = ts.prefix_hash(buf)
                _, inv = ts.powers(len(buf))
                grams = ts.mix((c[k:] - c[:-k]) * inv[: len(buf) - k + 1])
                at, lo, n = ts.anchors(grams, first, length, k)
                if not len(at):
                    continue
                cls, lo, n, parent = repeats.split(grams[at], at, lo, n, levels, c, length)
                doc = np.searchsorted(first, lo, "right") - 1
                view = memoryview(np.ascontiguousarray(buf))
                seg = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist())), np.uint64, len(lo))
                yield pa.record_batch({"cls": cls.view(np.int64), "seg": seg.view(np.int64), "doc_id": ids[i:j][doc], "lo": lo - first[doc], "n": n.astype(np.int32), "parent": parent.view(np.int64)})

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.utf8(batch.column("text"))
            ids, want = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("want")
            flat, at = want.flatten(), np.concatenate([[0], np.cumsum(want.value_lengths().to_numpy())])
            cls, copies, lo, n = (flat.field(x).to_numpy() for x in ("cls", "copies", "lo", "n"))
            row = np.repeat(np.arange(len(ids)), np.diff(at))
            a = off[row] + lo
            b = a + n + length - 1
            view = memoryview(np.ascontiguousarray(data))
            for i in range(0, len(row), 4096):
                s = slice(i, i + 4096)
                yield pa.record_batch({"cls": cls[s], "copies": copies[s], "doc_id": ids[row[s]], "lo": lo[s], "n": n[s], "body": pa.array([view[x:y].tobytes() for x, y in zip(a[s].tolist(), b[s].tolist())], pa.binary())})

    return run


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+n[0]-1, start[1] .. and so on."""
    total = int(n.sum())
    out = np.ones(total, np.int64)
    ends = np.cumsum(n)
    out[0] = start[0]
    out[ends[:-1]] = start[1:] - (start[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def _buckets(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers: for each key the first place that its equals take when sorted, as in a suffix array."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    return out


def repeated(bodies: list[bytes], n: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """For each window (``n[i]`` starts in ``bodies[i]``), whether its first ``length`` bytes start twice or more.

    Buckets of q-grams, q = length / 2**r, are refined r times. Only suffixes in buckets of two or more go on.
    """
    text = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)
    base = np.cumsum(size) - size
    q, steps = length, 0
    while q > 64:
        q, steps = -(-q // 2), steps + 1
    reach = [q]  # prefix lengths that the rounds sort by
    for _ in range(steps):
        reach.append(min(2 * reach[-1], length))
    start = _ranges(base, n)
    weight = np.repeat(copies, n)
    c = ts.prefix_hash(text)
    _, inv = ts.powers(len(text))
    bucket = np.full(len(text), -1, np.int64)
    p = _ranges(base, size - q + 1)
    bucket[p] = _buckets(ts.mix((c[p + q] - c[p]) * inv[p]))
    live = np.ones(len(start), bool)
    for now, then in zip(reach[:-1], reach[1:]):
        step = then - now
        crowd = np.bincount(bucket[p], minlength=len(text))
        # a suffix stays while its bucket has company, or while a longer suffix still points at it
        keep = p[crowd[bucket[p]] > 1]
        keep = keep[bucket[np.minimum(keep + step, len(text) - 1)] >= 0]
        inside = np.searchsorted(base, keep, "right") - 1
        keep = keep[keep + then <= base[inside] + size[inside]]
        later = bucket[keep + step]
        new = _buckets(bucket[keep] * np.int64(len(text) + 1) + later) if len(keep) else keep
        bucket[p] = -1
        bucket[keep] = new
        p = keep
    live = bucket[start] >= 0
    total = np.bincount(bucket[start[live]], weights=weight[live], minlength=1)
    out = copies.repeat(n) > 1
    out[live] |= total[bucket[start[live]]] > 1
    return out


def _refine(length: int):
    def block(rows: list[tuple]) -> pa.RecordBatch:
        _, copies, doc, lo, n, bodies = zip(*rows)
        n, copies = np.array(n, np.int64), np.array(copies, np.int64)
        flag = repeated(list(bodies), n, copies, length)
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        flag &= copies[row] == 1  # copies are removed whole elsewhere
        i = np.flatnonzero(flag)
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1] + 1) | (row[i[1:]] != row[i[:-1]])
        head = np.flatnonzero(new)
        return pa.record_batch({"doc_id": np.array(doc, np.int64)[row[i[head]]], "start": np.array(lo, np.int64)[row[i[head]]] + offset[i[head]], "n": np.diff(np.append(head, len(i))).astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(x).to_pylist() for x in ("cls", "copies", "doc_id", "lo", "n", "body"))):
                if size > BLOCK and r[0] != rows[-1][0]:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield block(rows)

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.utf8(batch.column("text"))
            data = np.ascontiguousarray(data)
            spans = batch.column("spans")
            flat, at = spans.flatten(), np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
            start, n = (flat.field(x).to_numpy() for x in ("start", "n"))
            removed, runs, sha, kept = [], [], [], []
            for i in range(len(batch)):
                text = data[off[i] : off[i + 1]]
                a, b = ts.merge_spans(start[at[i] : at[i + 1]], start[at[i] : at[i + 1]] + n[at[i] : at[i + 1]] + length - 1)
                if len(a):
                    edge = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(text)]])
                    text = np.concatenate([text[x:y] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())])
                body = text.tobytes()
                removed.append(int((b - a).sum()))
                runs.append(len(a))
                sha.append(hashlib.sha256(body).hexdigest())
                kept.append(body)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": np.diff(off), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": sha, "kept": pa.array(kept, pa.binary())})

    return run


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``."""
    segments = lambda levels: repeats.named(docs).mapInArrow(_segments(length, levels), repeats.SEGMENTS)
    found, counted = repeats.resolved(segments, [max(1, math.isqrt(length - _gram_width(length) + 1)), 1], MOST)
    copied = counted.where("copies > 1").select("cls", "seg")
    whole = repeats.copies_of(found, copied).select("doc_id", F.col("lo").alias("start"), F.col("n").cast("long").alias("n"))
    bodies = repeats.with_texts(counted, docs, _cut(length), "cls long, copies long, doc_id long, lo long, n int, body binary")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    refined = bodies.repartition(parts, "cls").sortWithinPartitions("cls").mapInArrow(_refine(length), "doc_id long, start long, n long")
    spans = repeats.spans_by_doc(whole.unionByName(refined))
    return repeats.restored(repeats.texts(docs).join(spans, "doc_id", "left").mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
