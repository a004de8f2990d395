"""Operator 13 against plain Python, and its defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from phylomill.llm import importance as im

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_words", StringType()), StructField("a.`b", StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def grams(text, order):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, order, percent, least, buckets=im.BUCKETS):
    s, t = Counter(g % buckets for _, x in docs for g in grams(x, order)), Counter(g % buckets for x in target for g in grams(x, order))
    total, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets))))
    out = []
    for i, x in docs:
        g = [gain(f % buckets) for f in grams(x, order)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(g), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    best = {}
    for i, n, _, _, score in out:
        if n >= least and score is not None:
            best[i] = max(score, best.get(i, score))
    drawn = sorted(best, key=lambda i: (-best[i], i))[: percent * len(best) // 100]
    rank = {(i, best[i]): p + 1 for p, i in enumerate(drawn)}
    return [(*r, rank.get((r[0], r[4])) if r[1] >= least else None) for r in out]


@pytest.mark.parametrize("order,percent,least", [(1, 10, 20), (3, 35, 1)])
def test_equals_plain_python(spark, order, percent, least):
    rng = np.random.default_rng(order)
    vocabulary = ["Apfel", "pear", "Ärger", "x9", "42", "ünder", "tea", "ROAD", "日本"]
    glue = [" ", "-", "\n", "_", ". "]
    text = lambda n: "".join(vocabulary[int(rng.zipf(1.5)) % 9] + glue[int(rng.integers(5))] for _ in range(n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(150)]
    docs += [(3, docs[3][1]), (3, docs[4][1]), (200, None), (201, ""), (202, " -- "), (None, text(40)), (203, "long " * 60_000)]
    target = [text(30), None, "", "pear tea " * 20]
    df = spark.createDataFrame([(i, x, "own", "y") for i, x in docs], SCHEMA).repartition(3)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = [tuple(r) for r in im.draw(im.weights(df, goal, order), percent, least).collect()]
    assert sorted(got, key=str) == sorted(plain(docs, target, order, percent, least), key=str)
    drawn = im.resample(df, goal, percent, order, least)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in got if r[5]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b " * 20, "", "")] * 2 + [(2, "c d " * 20, "", "")], SCHEMA)
    assert im.draw(im.weights(none, none)).collect() == []
    rows = im.draw(im.weights(some, none), 100).collect()
    assert sorted({(r.doc_id, r["rank"]) for r in rows}) in ([(1, 1), (2, 2)], [(1, 2), (2, 1)]) and len(rows) == 3


def test_a_crc_is_taken_once_for_a_distinct_gram(monkeypatch):
    calls = []
    monkeypatch.setattr(im.zlib, "crc32", lambda *x, f=zlib.crc32: calls.append(1) or f(*x))
    row, bucket, n = im.features(pa.array(["a b " * 50, "b a"]), 2)
    assert n.tolist() == [100, 2] and len(row) == 100 + 99 + 2 + 1
    assert len(calls) <= 3 + 3  # a, b and what is empty; a b, b a, and b b across the texts


def test_target_like_documents_are_drawn(spark):
    docs = spark.createDataFrame([(i, ("solve the equation for x " if i % 10 == 0 else "the weather in town is fine ") * 6) for i in range(600)], "doc_id long, text string")
    goal = spark.createDataFrame([("solve this equation for x",)] * 200, "text string")
    drawn = [r.doc_id for r in im.resample(docs, goal).collect()]
    assert len(drawn) == 60 and sum(i % 10 == 0 for i in drawn) >= 20  # 6 by chance
