"""Operator 7: a regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text are made in numpy for a batch of documents at a time. Spark sums the labelled rows'
means and covariances by class (all of them: what reaches the driver is two rows of P + P(P+1)/2 numbers). Each
class covariance is shrunk towards the pooled one and a multiple of the identity; its Cholesky factor is made once
and used for the Mahalanobis log-density of every document. The score is the class probability of label 1 at the
classes' shares among the labelled rows, tempered by ``TEMPERATURE``.

Only rows whose crc32 of the doc_id as text isn't 2 modulo 4 are learnt from. Labels, language, source and doc_id
are no inputs of a score.

Defined cases: a null text counts as empty, and an empty text has a score like any other; labels other than 0 and 1,
and labels of unknown documents, are left out; several labels of a document all count; with fewer than two labelled
documents of a class every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomill.llm import textscan as ts
from phylomill.stash import stash

POOL, RIDGE = 0.1, 0.02  # shares of the pooled covariance and of the identity (features are standardised)
TEMPERATURE = 2.0
CUT = 0.7
NAMES = ("words", "word_length", "length_spread", "symbols", "digits", "upper", "points", "odd_points", "breaks", "dup_lines", "repeats", "distinct", "short", "longest")
P = len(NAMES)
_SYMBOL, _DIGIT, _UPPER, _POINT, _ODD, _BREAK = range(6)
_KIND = np.zeros((6, 256), bool)
for _k, _chars in enumerate((b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".,", b"!?;:'\"()[]{}=/\\+-_@~^`", b"\n")):
    _KIND[_k, list(_chars)] = True


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return c[first[1:]] - c[first[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document, how many of its keys are equal to an earlier one of it."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[1:][same], minlength=n).astype(float)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of P transformed statistics for each document of a slice."""
    n = len(off) - 1
    words = ts.Words(data, off)
    h, first = words.hashes(), words.first
    doc = np.repeat(np.arange(n), np.diff(first))
    size = (words.end - words.start).astype(float)
    count = np.diff(first).astype(float)
    some, chars = np.maximum(count, 1), np.maximum(_per_doc(size, first), 1)
    mean = chars / some
    spread = np.sqrt(np.maximum(_per_doc(size**2, first) / some - mean**2, 0))
    longest = np.zeros(n)
    if len(size):
        np.maximum.at(longest, doc, size)
    kinds = [_per_doc(_KIND[k][data], off) for k in range(6)]
    # lines, as the words between two line breaks
    breaks = np.concatenate([[0], np.cumsum(_KIND[_BREAK][data])])
    line = breaks[words.start]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h)))) if len(h) else np.zeros(0, int)
    lines = np.add.reduceat(ts.mix(h + ts.mix(place.astype(np.uint64))), at) if len(at) else h
    grams = ts.gram_hash(h, 3)
    whole = doc[: len(grams)] == doc[2:] if len(grams) else np.zeros(0, bool)
    dup_lines = _repeats(lines, doc[at], n)
    again = _repeats(grams[whole], doc[: len(grams)][whole], n)
    distinct = count - _repeats(h, doc, n)
    share = lambda x, y, scale: np.log1p(scale * x / y)
    return np.column_stack([
        np.log1p(count), np.log(mean), np.log1p(spread),
        share(kinds[_SYMBOL], chars, 100), share(kinds[_DIGIT], chars, 100), share(kinds[_UPPER], chars, 100), share(kinds[_POINT], chars, 100), share(kinds[_ODD], chars, 100),
        share(kinds[_BREAK], some, 50), share(dup_lines, some, 100), share(again, some, 20),
        np.log1p(distinct) - np.log1p(count), share(_per_doc(size <= 3, first), some, 10), np.log1p(longest),
    ])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = ts.utf8(batch.column("text"))
        for i, j in ts.slices(off):
            x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), *map(pa.array, x.T)], names=["doc_id", *(f"x{k}" for k in range(P))])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x0 ..): the transformed statistics of every row."""
    return docs.select("doc_id", "text").mapInArrow(_features, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"x{k} double" for k in range(P)))


def held_out(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


class Discriminant:
    """Class means, log shares and Cholesky factors in standardised features."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, cov: np.ndarray):
        self.prior = float(n[1] / n.sum()) if n.sum() else 0.5
        self.usable = bool((n >= 2).all())
        if not self.usable:
            return
        share = n / n.sum()
        pooled = (share[:, None, None] * cov).sum(0)
        self.centre = share @ mean
        spread = mean - self.centre
        self.scale = np.sqrt(np.diag(pooled) + (share[:, None] * spread**2).sum(0)) + 1e-6
        self.mean = spread / self.scale
        unit = np.outer(self.scale, self.scale)
        shrunk = (1 - POOL - RIDGE) * cov / unit + POOL * pooled / unit + RIDGE * np.eye(P)
        root = np.linalg.cholesky(shrunk)
        self.shift = np.log(share) - np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1)
        self.whiten = np.linalg.inv(root)  # of a triangular factor: small, and kept for every batch

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [self.shift[c] - 0.5 * (((z - self.mean[c]) @ self.whiten[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / TEMPERATURE, -700, 700)))


def fit(rows: DataFrame) -> Discriminant:
    """From rows with ``quality`` and x0 ..; sums are made by Spark, and two rows come back."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in range(P)] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}_{j}") for i, j in pairs]
    n, mean, cov = np.zeros(2), np.zeros((2, P)), np.zeros((2, P, P))
    for r in rows.where("quality IN (0, 1)").groupBy("quality").agg(F.count("*").alias("n"), *sums).collect():
        c = int(r["quality"])
        n[c], mean[c] = r["n"], [r[f"m{i}"] for i in range(P)]
        for i, j in pairs:
            cov[c, i, j] = cov[c, j, i] = r[f"v{i}_{j}"]
    return Discriminant(n, mean, cov)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    rows = stash(features(docs).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False))), "features")
    model = fit(rows.where("NOT held_out").join(labels.select("doc_id", "quality"), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.column_stack([batch.column(f"x{k}").to_numpy() for k in range(P)]).reshape(-1, P))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return classify(read("documents"), read("labels"))
