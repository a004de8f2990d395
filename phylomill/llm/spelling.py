"""Operator 12: spelling variants of frequent words, by finite-state composition.

The vocabulary is an acceptor; composed with the transducer of exactly one edit and with itself again, it accepts the
pairs of words one inserted, deleted or replaced code point apart. Its paths are enumerated per initial state: words are
dealt by a prefix, the state that is reached after it, or by a suffix, the same for the reversed acceptor. Of a pair
whose shorter word has m code points, the first m // 2 are equal, or else all after the code point before them are. What
follows the initial state is minimised in a task and composed there. While no edit has been made, both copies of the
deterministic acceptor are in one state, so only arcs out of one state have to be paired, and what remains is the
intersection of two states' right languages, kept for every pair of states.

An initial state with more than ``MOST`` words, or with very long ones, is replaced by states further on: what lies
between prefix and suffix is halved again, down to one code point, where the alphabet bounds the words that are left.
Every pair belongs to one state: its common prefix decides.

Defined cases: a null or empty text has no words; a row without a doc_id counts its words and is never damaged; repeated
rows count again; an empty table or vocabulary gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomill.llm import textscan as ts
from phylomill.stash import discard, stash

LEAST_LENGTH, LEAST_COUNT = 5, 3
RATIO = 2  # how many times as frequent a form is, at least
MOST = 2_000
SPAN = 64  # code points between prefix and suffix, at most, where two words share them
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3  # the first of the two bytes of U+00C0 to U+00FF, and of no other character


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The maximal runs of Latin letters in a slice of texts, A-Z lower-cased, and their texts' numbers."""
    data = ts.LOWER[data]
    lead = data == _LEAD
    solid = _LETTER[data] | lead
    solid[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    joined = np.zeros(len(data) + 1, bool)  # to the byte before
    joined[1:-1] = solid[1:] & solid[:-1] & ~edge[1:-1]
    start, end = np.flatnonzero(solid & ~joined[:-1]), np.flatnonzero(solid & ~joined[1:]) + 1
    at = np.append(0, np.cumsum(end - start)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[solid])))
    return words.dictionary_encode(), np.searchsorted(offsets, start, "right") - 1


@lru_cache(256)
def _advance(length: int) -> np.ndarray:
    """For each byte of a CRC, what it becomes when ``length`` bytes follow (linear, so four tables of 256)."""
    zeros = b"\0" * length
    bits = [zlib.crc32(zeros, 1 << b) ^ zlib.crc32(zeros) for b in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(8):
            table[k, np.arange(256) >> b & 1 == 1] ^= np.uint32(bits[8 * k + b])
    return table


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of pairs of byte strings from their own ones and the second's length."""
    out = second.copy()
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        c, t = first[at], _advance(n)
        out[at] ^= t[0, c & 255] ^ t[1, c >> 8 & 255] ^ t[2, c >> 16 & 255] ^ t[3, c >> 24]
    return out


def _counted(least: int, damage: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, off = ts.utf8(batch.column("text"))
            for i, j in ts.slices(off):
                words, doc = runs(data[off[i] : off[j]], off[i : j + 1] - off[i])
                index, names = words.indices.to_numpy().astype(np.int64), words.dictionary
                size = pc.utf8_length(names).to_numpy()
                more: Counter[str] = Counter()
                if damage:
                    pair, times = np.unique(doc * max(len(names), 1) + index, return_counts=True)
                    d, index = pair // max(len(names), 1), pair % max(len(names), 1)
                    of_doc = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[i:j]], np.uint32)
                    of_word = np.array([zlib.crc32(x.encode()) for x in names.to_pylist()], np.uint32)
                    h = joined_crc(of_doc[d], of_word[index], pc.binary_length(names).to_numpy()[index])
                    hit = (h % np.uint32(damage) == 0) & np.array([x is not None for x in ids[i:j]], bool)[d]
                    for w, x, n in zip(names.take(pa.array(index[hit])).to_pylist(), h[hit].tolist(), times[hit].tolist()):
                        p = x % len(w)
                        more[w[:p] + w[p + 1 :]] += n
                    count = np.bincount(index[~hit], times[~hit], len(names)).astype(np.int64)
                else:
                    count = np.bincount(index, minlength=len(names))
                at = np.flatnonzero((count > 0) & (size >= least))
                extra = [(w, n) for w, n in more.items() if len(w) >= least]
                yield pa.record_batch({"word": pa.array(names.take(pa.array(at)).to_pylist() + [w for w, _ in extra], pa.string()), "n": pa.array(count[at].tolist() + [n for _, n in extra], pa.int64())})

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n): words of ``least_length`` code points or more and ``least_count`` occurrences or more.

    ``damage``: runs whose CRC-32 with their doc_id it divides lose one code point, which plants misspellings.
    """
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(least_length, damage), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """The minimal acceptor of sorted strings: state -> (arcs, final), state 0 accepts the empty string alone."""

    def __init__(self, strings: list[str]):
        self.arcs: list[tuple[tuple[str, int], ...]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._shared: dict[tuple[int, int], list[str]] = {}
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        last = ""
        for s in strings:
            k = 0
            while k < min(len(s), len(last)) and s[k] == last[k]:
                k += 1
            self._close(path, last, k)
            path.extend((False, []) for _ in s[k:])
            path[-1] = (True, path[-1][1])
            last = s
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(key[1])
            self.final.append(final)
        return self._known[key]

    def _close(self, path: list, last: str, k: int) -> None:
        while len(path) > k + 1:
            state = self._state(*path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    def shared(self, p: int, q: int) -> list[str]:
        """The strings that both states accept."""
        key = (p, q) if p <= q else (q, p)
        if key not in self._shared:
            out = [""] if self.final[p] and self.final[q] else []
            other = self.arcs[q] if p == q else dict(self.arcs[q])
            for c, to in self.arcs[p]:
                if p == q:
                    out += [c + s for s in self.shared(to, to)]
                elif c in other:
                    out += [c + s for s in self.shared(to, other[c])]
            self._shared[key] = out
        return self._shared[key]


def one_edit_pairs(strings: list[str], size: int, depth: int) -> Iterator[tuple[str, str]]:
    """Accepted pairs of the composition: strings of ``size`` with one replaced, or with one inserted into such a one, and a
    common prefix shorter than ``depth``. Every pair comes once (an insertion into equal letters, behind the last)."""
    a = Acceptor(strings)
    todo = [(a.start, "")]
    while todo:
        p, before = todo.pop()
        rest = size - len(before) - 1
        for x, (c, to) in enumerate(a.arcs[p]):
            for d, other in a.arcs[p][x + 1 :]:
                for s in a.shared(to, other):
                    if len(s) == rest:
                        yield before + c + s, before + d + s
            for s in a.shared(to, p):
                if len(s) == rest + 1 and s[:1] != c:
                    yield before + c + s, before + s
            if len(before) + 1 < depth:
                todo.append((to, before + c))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of an initial state: how many near words it has there, and the most frequent of them."""

    def enumerated(key: tuple, rows: list[tuple[str, int]], out: list) -> None:
        m, i, j, *_ = key
        cut = {w[i : len(w) - (m - j)]: (w, n) for w, n in rows}
        near: dict[str, list[int]] = {}
        for x, y in one_edit_pairs(sorted(cut), j - i, (j if j < m else m + 1) - i):
            for (w, _), (v, n) in ((cut[x], cut[y]), (cut[y], cut[x])):
                have = near.get(w)
                if have is None:
                    near[w] = [1, n, v]
                else:
                    have[0] += 1
                    if n > have[1] or n == have[1] and v < have[2]:
                        have[1:] = n, v
        out.extend((w, *x) for w, x in near.items())

    key, rows, out = None, [], []
    for batch in batches:
        for *k, w, n in zip(*(batch.column(c).to_pylist() for c in ("m", "i", "j", "before", "after", "word", "n"))):
            if k != key:
                if len(rows) > 1:
                    enumerated(key, rows, out)
                key, rows = k, []
            rows.append((w, n))
        yield _near_batch(out)
        out.clear()
    if len(rows) > 1:
        enumerated(key, rows, out)
    yield _near_batch(out)


def _near_batch(out: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "most", "best"])


_STATE = ["m", "i", "j", "before", "after"]


def _at(word: str, m: Column, i: Column, j: Column) -> Column:
    """An initial state: m code points in the shorter word, ``before`` the first i, ``after`` the last m - j."""
    before, after = F.substring(word, F.lit(1), i), F.substring(word, F.length(word) - (m - j) + 1, m - j)
    return F.struct(m.alias("m"), i.alias("i"), j.alias("j"), before.alias("before"), after.alias("after"))


def _halves(m: Column, i: Column, j: Column) -> Column:
    half = i + F.floor((j - i) / 2).cast("int")
    return F.array(_at("word", m, half, j), _at("word", m, i, half))


def initial_states(words: DataFrame, most: int = MOST) -> DataFrame:
    """(m, i, j, before, after, word, n): every word at every initial state that it can share with a near word."""
    size, zero = F.length("word"), F.lit(0)
    states = F.concat(_halves(size, zero, size), _halves(size - 1, zero, size - 1))
    rows = stash(words.select("word", "n", F.explode(states).alias("s")).select("s.*", "word", "n"), "states")
    done = None
    while True:
        large = rows.where("j - i > 1").groupBy(*_STATE).agg(F.count("*").alias("c")).where((F.col("c") > most) | (F.col("c") > 1) & (F.col("j") - F.col("i") > SPAN))
        large = stash(large.drop("c"), "large-states")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, _STATE, "left_anti")
        done = small if done is None else done.unionByName(small)
        split = rows.join(large, _STATE).select("word", "n", F.explode(_halves(F.col("m"), F.col("i"), F.col("j"))).alias("s"))
        rows = stash(split.select("s.*", "word", "n"), "states")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, most, best) for the words (word, n) with near words: their count, and the most frequent one."""
    states = initial_states(words, most).repartition(*_STATE).sortWithinPartitions(*_STATE)
    found = states.mapInArrow(_compose, "word string, n_near long, most long, best string")
    best = F.min(F.struct((-F.col("most")).alias("most"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.most")).alias("most"), F.col("b.best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms that starts at each word of (word, form).

    A form is at least twice as frequent, so a chain has no ring and under 64 links; pointers double in each round.
    """
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        new = stash(now.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        discard(now)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of the vocabulary (word, n)."""
    near = near_words(words, most)
    out = words.join(near, "word", "left")
    is_form = F.col("most") >= ratio * F.col("n")
    out = stash(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("most")).alias("form_n")), "forms")
    root = followed(out.where("form IS NOT NULL"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(stash(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=97), "vocabulary"))
