"""Operator 8: SentencePiece encoding and decoding by batched numpy Viterbi.

A text is escaped as the model says (a dummy prefix, blanks as U+2581) and cut into units before each run of blanks;
no piece of the vocabulary crosses such a cut, which ``Model`` checks. The distinct units of a batch are grouped by
their number of characters, and the units of a group advance together: for every piece length the hashes of all
substrings probe the sorted keys of the pieces of that length, and at each position the maximum over the piece
lengths gives the best score and the back pointer. Ties take the shortest last piece.

A unit of more than ``LONG`` characters (text without blanks) is cut further wherever no piece that matches there
crosses, so that Han text or random letters fall into short units as well. What stays long, such as one letter over and
over, is walked alone in windows of ``WINDOW`` characters over the pieces that match, with the scores of the last few
positions carried on: memory beyond the text is a window's.

The result is the segmentation with the greatest sum of the model's own piece scores. A character that no piece
covers costs the least score less 10, as in SentencePiece, and becomes its UTF-8 bytes' pieces.

Defined cases: columns of ``docs`` that are named like a result are replaced by it; a null text is treated as empty, and an empty text has no pieces (as in SentencePiece); a text's own
U+2581 decodes as a blank; unpaired surrogates can't occur in Spark strings. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from phylomill.llm import textscan as ts
from phylomill.llm.repeats import by_place, quoted

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
NORMAL, BYTE = 1, 6
SLICE = 2_000_000  # characters that are encoded at a time
CELLS = 250_000  # characters of one group of equally long units
LONG = 48  # characters of a unit that isn't cut further
WINDOW = 1 << 16  # characters whose pieces are looked up at a time in long units


def _hash(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers for hashes of substrings of code points."""
    p, inv = ts.powers(chars.size)
    c = np.zeros(chars.size + 1, np.uint64)
    np.cumsum(ts.mix(chars.astype(np.uint64) + np.uint64(1)) * p, out=c[1:])
    return c, inv


class Model:
    """Pieces of a SentencePiece model file: sorted hashes, ids and scores by piece length."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are can be used")
        self.prefix = norm.add_dummy_prefix
        pieces = [(i, p.piece, p.score, p.type) for i, p in enumerate(proto.pieces)]
        if any(chr(BLANK) in p.lstrip(chr(BLANK)) for _, p, _, kind in pieces if kind == NORMAL):
            raise ValueError("a piece has a blank after another character")
        self.byte_ids = np.full(256, -1, np.int32)
        for i, p, _, kind in pieces:
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.unknown = min(s for _, _, s, kind in pieces if kind == NORMAL and s > -1e8) - 10
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for _, p, _, kind in pieces if kind == NORMAL}):
            own = [(i, p, s) for i, p, s, kind in pieces if kind == NORMAL and len(p) == n]
            c, inv = _hash(np.array([[ord(ch) for ch in p] for _, p, _ in own], np.uint32).ravel())
            at = np.arange(len(own)) * n
            key = (c[at + n] - c[at]) * inv[at]
            order = np.argsort(key)
            if (np.diff(key[order]) == 0).any():
                raise ValueError("two pieces have one hash")
            self.tables[n] = key[order], np.array([i for i, _, _ in own], np.int32)[order], np.array([s for _, _, s in own])[order]
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(chr(BLANK), " ").encode() if kind == NORMAL else b"" for _, p, _, kind in pieces]

    def escaped(self, text: str) -> str:
        return (" " + text if self.prefix else text).replace(" ", chr(BLANK)) if text else ""

    def decode(self, ids: list[int]) -> str:
        body = b"".join(map(self.bytes.__getitem__, ids))
        return (body[1:] if self.prefix and body[:1] == b" " else body).decode("utf-8", "replace")

    def _found(self, chars: np.ndarray, starts: int, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, starts, ids, scores) of the pieces that match at one of the first ``starts`` places."""
        c, inv = _hash(chars)
        for n, (keys, ids, scores) in self.tables.items():
            if least <= n <= len(chars):
                at = np.arange(min(starts, len(chars) - n + 1))
                h = (c[at + n] - c[at]) * inv[at]
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[i] == h)
                yield n, hit, ids[i[hit]], scores[i[hit]]

    def _free(self, chars: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Places that no matching piece crosses; ``unit`` says which unit a character belongs to."""
        reach, size = max(self.tables) - 1, len(chars)
        change = np.zeros(size + 2, np.int32)
        for a in range(0, size, WINDOW):
            for n, at, _, _ in self._found(chars[a : a + WINDOW + reach], WINDOW, 2):
                at = at + a
                at = at[unit[at] == unit[at + n - 1]]
                np.add.at(change, at + 1, 1)
                np.add.at(change, at + n, -1)
        return np.cumsum(change)[:size] == 0

    def _walk(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of long units that follow each other: ids of all, and how many each has."""
        size, reach = len(chars), max(self.tables)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        back, piece = np.zeros(size + 1, np.int16), np.full(size + 1, -1, np.int32)
        best, last, own = [0.0] + [-np.inf] * reach, [0] * (reach + 1), [-1] * (reach + 1)
        for a in range(0, size, WINDOW):
            n_here = min(WINDOW, size - a)
            best, last, own = best + [-np.inf] * n_here, last + [0] * n_here, own + [-1] * n_here
            rows = list(self._found(chars[a : a + n_here + reach - 1], n_here))
            alone = np.ones(n_here, bool)
            for n, at, _, _ in rows:
                if n == 1:
                    alone[at] = False
            alone = np.flatnonzero(alone)
            rows.append((1, alone, np.full(len(alone), -1, np.int32), np.full(len(alone), self.unknown)))
            at, ids, scores = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
            width = np.concatenate([np.full(len(r[1]), r[0]) for r in rows])
            inside = unit[a + at] == unit[a + at + width - 1]
            at, ids, scores, width = at[inside], ids[inside], scores[inside], width[inside]
            order = np.argsort(at, kind="stable")
            for x, n, i, w in zip(at[order].tolist(), width[order].tolist(), ids[order].tolist(), scores[order].tolist()):
                total = best[x] + w
                if total >= best[x + n]:  # later starts are shorter last pieces
                    best[x + n], last[x + n], own[x + n] = total, n, i
            upto = min(len(last), size + 1 - a)
            back[a : a + upto], piece[a : a + upto] = last[:upto], own[:upto]
            best, last, own = best[n_here:], last[n_here:], own[n_here:]
        end, found = size, []
        steps = back.tolist()
        while end:
            found.append(end)
            end -= steps[end]
        end = np.array(found[::-1])
        row, ids = unit[end - 1], piece[end]
        if (ids < 0).any():
            return self._with_bytes(chars[None, :], np.zeros(len(end), np.int64), end, ids, row, len(sizes))
        return ids, np.bincount(row, minlength=len(sizes))

    def _group(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units of one length (a row each): ids of all rows one after the other, and how many each has."""
        m, size = chars.shape
        c, inv = _hash(chars.ravel())
        base = np.arange(m)[:, None] * size
        lengths = [n for n in self.tables if n <= size]
        piece = np.full((len(lengths), m, size + 1), -1, np.int32)
        score = np.full((len(lengths), m, size + 1), -np.inf)
        for k, n in enumerate(lengths):
            keys, ids, scores = self.tables[n]
            at = base + np.arange(size - n + 1)
            h = (c[at + n] - c[at]) * inv[at]
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[i] == h
            piece[k, :, n:] = np.where(hit, ids[i], -1)
            score[k, :, n:] = np.where(hit, scores[i], -np.inf)
        if lengths and lengths[0] == 1:
            lone = piece[0, :, 1:] < 0
            score[0, :, 1:][lone] = self.unknown
        best = np.full((m, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, size + 1), np.int8 if len(lengths) < 128 else np.int32)
        steps = np.array(lengths)
        for i in range(1, size + 1):
            can = int(np.searchsorted(steps, i, "right"))
            total = best[:, i - steps[:can]].T + score[:can, :, i]
            back[:, i] = total.argmax(axis=0)
            best[:, i] = total.max(axis=0)
        # follow the back pointers of all rows together
        end, row, found = np.full(m, size), np.arange(m), []
        while len(row):
            k = back[row, end]
            found.append((row, end, piece[k, row, end]))
            end = end - steps[k]
            row, end = row[end > 0], end[end > 0]
        row, end, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((end, row))
        row, end, ids = row[order], end[order], ids[order]
        if (ids < 0).any():
            return self._with_bytes(chars, row, end, ids, row, m)
        return ids, np.bincount(row, minlength=m)

    def _with_bytes(self, chars: np.ndarray, row: np.ndarray, end: np.ndarray, ids: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
        lone = np.flatnonzero(ids < 0)
        code, which = np.unique(chars[row[lone], end[lone] - 1], return_inverse=True)
        spelled = [self.byte_ids[np.frombuffer(chr(x).encode(), np.uint8)] for x in code.tolist()]
        width = np.ones(len(ids), np.int64)
        width[lone] = np.array([len(s) for s in spelled])[which]
        out, at = np.repeat(ids, width), np.cumsum(width) - width
        for k, s in enumerate(spelled):
            places = at[lone[which == k]]
            for b, x in enumerate(s):
                out[places + b] = x
        return out, np.bincount(unit, weights=width, minlength=units).astype(np.int64)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each text."""
        parts = [np.frombuffer(self.escaped(t).encode("utf-32-le"), np.uint32) for t in texts]
        first = np.cumsum([0] + [len(p) for p in parts])
        chars = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        blank = chars == BLANK
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[first[:-1][np.diff(first) > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(chars)))
        if (size > LONG).any():
            within = np.repeat(size > LONG, size)
            cut[np.flatnonzero(within)[self._free(chars[within], np.repeat(np.arange(len(size)), size)[within])]] = True
            start = np.flatnonzero(cut)
            size = np.diff(np.append(start, len(chars)))
        c, inv = _hash(chars)
        key = (c[start + size] - c[start]) * inv[start]
        _, index, which = np.unique(key, return_index=True, return_inverse=True)
        flat, count = [], np.zeros(len(index), np.int64)
        order = np.argsort(size[index], kind="stable")
        lengths = size[index][order]
        i, done, lone = 0, [], []
        while i < len(order):
            n = int(lengths[i])
            j = min(int(np.searchsorted(lengths, n, "right")), i + max(1, CELLS // n))
            own = index[order[i:j]]
            if n > LONG and j - i < 8:  # too few to advance together
                lone.append(order[i:j])
                i = j
                continue
            ids, counts = self._group(chars[start[own][:, None] + np.arange(n)])
            flat.append(ids)
            count[order[i:j]] = counts
            done.append(order[i:j])
            i = j
        if lone:
            lone = np.concatenate(lone)
            own, n = start[index[lone]], size[index[lone]]
            ids, count[lone] = self._walk(np.concatenate([chars[a : a + k] for a, k in zip(own.tolist(), n.tolist())]), n)
            flat.append(ids)
            done.append(lone)
        flat, done = np.concatenate(flat), np.concatenate(done)
        at = np.zeros(len(index), np.int64)
        at[done] = np.cumsum(count[done]) - count[done]
        many = count[which]
        ends = np.cumsum(many)
        place = np.arange(int(ends[-1])) - np.repeat(ends - many - at[which], many)
        units = np.searchsorted(start, first)
        return flat[place], np.concatenate([[0], ends])[units]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _encode(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([0] + [len(t) for t in texts])
            for i, j in ts.slices(sizes, SLICE):
                ids, off = m.encode_batch(texts[i:j])
                part = batch.slice(i, j - i)
                yield part.append_column(name, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())))

    return run


def _with(docs: DataFrame, *new: StructField) -> tuple[DataFrame, StructType]:
    """``docs`` without columns named like the new ones, and the schema with these."""
    names = {f.name.lower() for f in new}
    fields = [f for f in docs.schema.fields if f.name.lower() not in names]
    if len(fields) < len(docs.columns):
        docs = docs.select(*quoted([f.name for f in fields]))
    return docs, StructType([*docs.schema.fields, *new])


def encode(docs: DataFrame, path: str = MODEL, name: str = "pieces") -> DataFrame:
    """``docs`` with the ids of each text's pieces in ``name`` (array<int>)."""
    docs, schema = _with(docs, StructField(name, ArrayType(IntegerType())))
    return by_place(docs, _encode(path, name), schema, ("text",))


def decode(rows: DataFrame, path: str = MODEL, pieces: str = "pieces", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield batch.append_column(name, pa.array([m.decode(x or []) for x in batch.column(pieces).to_pylist()], pa.string()))

    rows, schema = _with(rows, StructField(name, StringType()))
    return by_place(rows, run, schema, (pieces,))


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([0] + [len(t) for t in texts])
            for i, j in ts.slices(sizes, SLICE):
                ids, off = m.encode_batch(texts[i:j])
                own = [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                same = [m.decode(x.tolist()) == t.replace(chr(BLANK), " ") for x, t in zip(own, texts[i:j])]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "n_pieces": np.diff(off), "ids_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in own], "round_trip": same})

    return run


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256 of the little-endian 32-bit ids, round_trip: whether decoding gives the text)."""
    return docs.select("doc_id", "text").mapInArrow(_digest(path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_pieces long, ids_sha256 string, round_trip boolean")


def checked(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` with pieces (array<int>) and round_trip (boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in _encode(path, "pieces")(batches):
            same = [m.decode(x) == (t or "").replace(chr(BLANK), " ") for x, t in zip(batch.column("pieces").to_pylist(), batch.column("text").to_pylist())]
            yield batch.append_column("round_trip", pa.array(same, pa.bool_()))

    docs, schema = _with(docs, StructField("pieces", ArrayType(IntegerType())), StructField("round_trip", BooleanType()))
    return by_place(docs, run, schema, ("text",))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
