"""Operator 4: exact removal of repeated word passages by matching statistics on suffix automata.

A word is removed if a window of ``length`` words that covers it has the same word sequence as a window that starts
earlier (smaller doc_id, or the same document further up).

The reference is the corpus itself, so its automata can't all be sent everywhere. It is cut into shards along
anchor classes (see ``repeats``): a shard's automaton holds the distinct segments of its classes, some 100 thousand
words, and only the segments of those classes are streamed over it, in the order of their documents. A position
where the matching statistic reaches ``length`` ends a window that was there before; maximal runs of such windows
are removed. Segments that add something then extend the automaton. A class of more than ``MOST`` distinct segments
is split by the words around its anchor (see ``repeats``), so that no automaton holds more than a shard and ``MOST``
segments.

Defined cases: a row without a doc_id is left alone; a null or empty text has no words; equal documents lose everything but the first; white space is
ASCII only; repeated rows of one doc_id are one document, and both rows keep what that document keeps.
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

SHARD = 100_000  # words of reference in one automaton; a shard ends with a class
MOST = 2_500  # distinct segments of a class, of at most 2 * length words each
GRAM = 5


class SuffixAutomaton:
    """Of several word sequences; states know the longest sequence that leads to them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.longest = [0]

    def _state(self, longest: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """Where ``p`` goes by ``word``, cut off from what is longer in ``q``."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        new = self._state(self.longest[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words: list[int]) -> None:
        at = 0
        for w in words:
            q = self.next[at].get(w)
            if q is not None:
                at = self._split(at, w, q)
                continue
            new, p = self._state(self.longest[at] + 1, 0, {}), at
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w, self.next[p][w])
            at = new

    def statistics(self, words: list[int]) -> list[int]:
        """For each word, how long a match with the reference ends there."""
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.longest[at]
            q = self.next[at].get(w)
            if q is not None:
                at, n = q, n + 1
            out.append(n)
        return out


def _segments(length: int, k: int, levels: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in ts.slices(off):
                words = ts.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                h = words.hashes()
                grams = ts.gram_hash(h, k)
                at, lo, n = ts.anchors(grams, words.first, length, k)
                if not len(at):
                    continue
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * ts.powers(len(h))[0], dtype=np.uint64)]) if levels else h
                cls, lo, n, parent = repeats.split(grams[at], at, lo, n, levels, prefix, length)
                doc = np.searchsorted(words.first, lo, "right") - 1
                view = memoryview(h.tobytes())
                seg = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((8 * lo).tolist(), (8 * (lo + n + length - 1)).tolist())), np.uint64, len(lo))
                yield pa.record_batch({"cls": cls.view(np.int64), "seg": seg.view(np.int64), "doc_id": ids[i:j][doc], "lo": lo - words.first[doc], "n": n.astype(np.int32), "parent": parent.view(np.int64)})

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.utf8(batch.column("text"))
            ids, want = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("want").to_pylist()
            for i, j in ts.slices(off):
                words = ts.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                view = memoryview(words.hashes().tobytes())
                rows = [(x["cls"], ids[r], x["lo"], x["n"], view[8 * (a := words.first[r - i] + x["lo"]) : 8 * (a + x["n"] + length - 1)].tobytes()) for r in range(i, j) for x in want[r]]
                if rows:
                    cls, doc, lo, n, body = zip(*rows)
                    yield pa.record_batch({"cls": np.array(cls, np.int64), "doc_id": np.array(doc, np.int64), "lo": np.array(lo, np.int64), "n": np.array(n, np.int32), "body": pa.array(body, pa.binary())})

    return run


def _stream(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, last = SuffixAutomaton(), 0, None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for cls, doc, lo, n, body in zip(*(batch.column(x).to_pylist() for x in ("cls", "doc_id", "lo", "n", "body"))):
                if last == (cls, doc, lo):
                    continue
                if held > SHARD and cls != last[0]:
                    shard, held = SuffixAutomaton(), 0
                last = (cls, doc, lo)
                words = np.frombuffer(body, np.int64).tolist()
                match = shard.statistics(words)
                seen = [x >= length for x in match[length - 1 :]]
                if not all(seen):
                    shard.add(words)
                    held += len(words)
                i = 0
                while i < n:
                    if seen[i]:
                        j = i
                        while j < n and seen[j]:
                            j += 1
                        out.append((doc, lo + i, j - i))
                        i = j
                    i += 1
            a = np.array(out, np.int64).reshape(-1, 3)
            yield pa.record_batch({"doc_id": a[:, 0], "start": a[:, 1], "n": a[:, 2]})

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sha, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                total.append(len(words))
                if spans:
                    start, n = np.array([(s["start"], s["n"]) for s in spans], np.int64).T
                    a, b = ts.merge_spans(start, start + n + length - 1)
                    edge = [0, *np.stack([a, b], 1).ravel().tolist(), len(words)]
                    words = [w for x, y in zip(edge[::2], edge[1::2]) for w in words[x:y]]
                body = b" ".join(words)
                removed.append(total[-1] - len(words))
                sha.append(hashlib.sha256(body).hexdigest())
                kept.append(body.decode())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    return run


def dedup(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of ``docs``."""
    k = min(GRAM, length)
    segments = lambda levels: repeats.named(docs).mapInArrow(_segments(length, k, levels), repeats.SEGMENTS)
    found, counted = repeats.resolved(segments, [max(1, math.isqrt(length - k + 1)), 1], MOST, keep=False)
    copied = counted.where("copies > 1").select("cls", "seg", F.col("first.doc_id").alias("d0"), F.col("first.lo").alias("lo0"))
    later = repeats.copies_of(found, copied).where("doc_id != d0 OR lo != lo0").select("doc_id", F.col("lo").alias("start"), F.col("n").cast("long").alias("n"))
    bodies = repeats.with_texts(counted, docs, _cut(length), "cls long, doc_id long, lo long, n int, body binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = bodies.repartition(parts, "cls").sortWithinPartitions("cls", "doc_id", "lo").mapInArrow(_stream(length), "doc_id long, start long, n long")
    spans = repeats.spans_by_doc(later.unionByName(streamed))
    return repeats.restored(repeats.texts(docs).join(spans, "doc_id", "left").mapInArrow(_remove(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"))


def op4_automaton_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
