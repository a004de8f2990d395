"""Contracted trees against the passes level by level, and deep trees against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from phylomill.operators import contraction as ct
from phylomill.operators import trees as tr

CODES = {"reversible": (tr.reversible_ancestors, [1, 2, 3]), "dna": (tr.dna_ancestors, [1, 2, 4, 8, 3, 15, 16])}


def grown(seed, n, deep):
    r = random.Random(seed)
    edges = [(f"i{r.randint(max(0, k - deep), k - 1)}", f"i{k}") for k in range(1, n)]
    inner = {"i0", *(p for p, _ in edges), *(c for _, c in edges)}
    return edges + [(p, f"t{k}x{j}") for k, p in enumerate(sorted(inner)) for j in range(r.choice([1, 1, 2, 3]))]


@pytest.mark.parametrize("kind", sorted(CODES))
def test_contraction_equals_levels(spark, monkeypatch, kind):
    f, values = CODES[kind]
    r = random.Random(1)
    rows = [(t, *e) for t, (n, deep) in {"A": (20, 99), "B": (12, 2), "C": (1, 1), "D": (8, 1)}.items() for e in grown(n, n, deep)]
    edges = spark.createDataFrame(rows, "tree_id string, parent string, child string").cache()
    inner = {(t, p) for t, p, _ in rows}
    tips = [(t, c, s, r.choice(values)) for t, _, c in rows if (t, c) not in inner for s in range(3) if r.random() < 0.6]
    codes = spark.createDataFrame(tips, "tree_id string, tip string, site int, code int").cache()
    depth = tr.levels(edges).cache()
    got = {}
    for deep in (0, 10**6):
        monkeypatch.setattr(tr, "DEEP", deep)
        got[deep] = sorted(map(tuple, f(edges, codes, depth).collect()))
    assert got[0] and got[0] == got[10**6]


def test_a_deep_caterpillar(spark, monkeypatch):
    """Ten thousand levels in under thirty rounds each way."""
    made = []
    monkeypatch.setattr(ct, "stash", lambda df, name, f=ct.stash: made.append(name) or f(df, name))
    n = 10_000
    name = lambda k: F.format_string("i%05d", k)
    kids = F.array(F.when(F.col("id") < n - 1, name(F.col("id") + 1)), F.format_string("t%05d", "id"), F.when(F.col("id") == n - 1, F.lit("u")))
    edges = spark.range(n).select(F.lit("T").alias("tree_id"), name(F.col("id")).alias("parent"), F.explode(F.array_compact(kids)).alias("child")).cache()
    code = lambda k: 1 + (k * 7919 + k // 3) % 97 % 2
    tips = [("T", f"t{k:05d}", 0, code(k)) for k in range(n)] + [("T", "u", 0, 2)]
    out = tr.reversible_ancestors(edges, spark.createDataFrame(tips, "tree_id string, tip string, site int, code int"), spark.createDataFrame([(n,)], "depth int"))
    got = {r.node: r.code for r in out.collect()}
    up, x = {}, 2
    for k in range(n - 1, -1, -1):
        x = (x & code(k)) or 3
        up[k] = x
    want, above = {}, 1
    for k in range(n):
        above = up[k] if up[k] != 3 else above
        want[f"i{k:05d}"] = above
    assert got == want
    assert made.count("contracted") < 30 and made.count("functions") < 30
