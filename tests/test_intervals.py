"""Intervals, lifting and scans against the closure and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from phylomill.operators import intervals as iv
from phylomill.operators import rooting as ro
from phylomill.operators import scans
from phylomill.operators import support as su
from phylomill.operators import trees as tr


def random_tree(seed, n, deep):
    """(parent, child, length) with n inner nodes; ``deep``: how far back a parent is looked for."""
    r = random.Random(seed)
    out = [(f"i{r.randint(max(0, k - deep), k - 1)}", f"i{k}", float(r.randint(0, 3))) for k in range(1, n)]
    inner = {p for p, _, _ in out} | {f"i{k}" for k in range(n)}
    for k, p in enumerate(sorted(inner)):
        out += [(p, f"t{k}x{j}", 1.0) for j in range(r.choice([0, 1, 1, 2]))]
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rows = [(t, *e) for t, (seed, n, deep) in {"A": (1, 40, 99), "B": (2, 60, 2), "C": (3, 1, 1), "D": (4, 45, 1)}.items() for e in random_tree(seed, n, deep) or [("i0", "t0", 1.0)]]
    return rows, spark.createDataFrame(rows, "tree_id string, parent string, child string, length double").cache()


def above(rows):
    """{(tree, node): its proper ancestors, nearest first}"""
    up = {(t, c): p for t, p, c, _ in rows}
    out = {}
    for t, c in [*up, *{(t, p) for t, p, _, _ in rows}]:
        way, x = [], c
        while (t, x) in up:
            x = up[t, x]
            way.append(x)
        out[t, c] = way
    return out


def test_intervals_equal_the_closure(spark, forest):
    rows, df = forest
    spans = iv.intervals(df).cache()
    got = {(r.tree_id, r.node): r for r in spans.collect()}
    way = above(rows)
    tips = {(t, c) for t, _, c, _ in rows} - {(t, p) for t, p, _, _ in rows}
    assert got.keys() == way.keys()
    for (t, x), r in got.items():
        under = {y for (u, y), w in way.items() if u == t and x in w}
        assert {y for (u, y), q in got.items() if u == t and r.enter < q.enter <= r.leave} == under
        leaves = {y for y in under | {x} if (t, y) in tips}
        assert r.tips == len(leaves) and {y for (u, y) in tips if u == t and r.first <= got[u, y].first < r.first + r.tips} == leaves
        assert r.depth == len(way[t, x])
    assert sorted(q.enter for q in got.values()) == sorted(k for t in "ABCD" for k in range(sum(u == t for u, _ in way)))
    assert sorted(map(tuple, iv.sizes(spans).collect())) == sorted(map(tuple, tr.clade_sizes(tr.clades(df)).select("tree_id", "node", "size").collect()))
    nodes = spark.createDataFrame([("A", "i0"), ("A", "i3"), ("B", "i5"), ("D", "i30")], "tree_id string, node string")
    below = {tuple(r) for r in iv.below(spans, nodes).collect()}
    assert below == {(t, x, y) for t, x in map(tuple, nodes.collect()) for (u, y), w in way.items() if u == t and x in w}
    assert spans.count() == len(way)  # a row for each node


def test_nested_and_flagged_nodes_equal_plain_rules(spark, forest):
    rows, df = forest
    way, r = above(rows), random.Random(9)
    inner = sorted({(t, p) for t, p, _, _ in rows})
    flags, tops = set(r.sample(inner, 40)), set(r.sample(inner, 40))
    table = lambda s: spark.createDataFrame(sorted(s), "tree_id string, node string")
    want = {(t, x) for t, x in flags if not any((t, a) in flags for a in way[t, x])}
    assert {tuple(x) for x in tr.topmost(df, table(flags)).collect()} == want
    want = set()
    for t, x in flags:
        for a in way[t, x]:
            if (t, a) in tops:
                want.add((t, a, x))
            if (t, a) in flags:
                break
    assert {tuple(x) for x in su.maximal_flagged(df, table(flags), table(tops)).collect()} == want
    marks = set(r.sample(inner, 6))
    marked = marks | {(t, a) for t, x in marks for a in way[t, x]}
    want = {(t, c) for t, p, c, _ in rows if (t, p) in marked and (t, c) not in marked}
    spans = iv.intervals(df).cache()
    assert {tuple(x) for x in ro.unbroken(df, spans, table(marks)).collect()} == want
    tips = {(t, c) for t, _, c, _ in rows} - set(inner)
    chosen = [(s, x) for s in (1, 2) for x in {c for _, c in tips} if r.random() < 0.9]
    whole = {}
    for t, x in inner:
        leaves = {y for (u, y) in tips if u == t and x in way[u, y]}
        for s in (1, 2):
            if leaves and all((s, y) in chosen for y in leaves):
                whole[t, s, x] = len(leaves)
    want = {(t, s, x, k) for (t, s, x), k in whole.items() if not way[t, x] or (t, s, way[t, x][0]) not in whole}
    got = su.maximal_nested(df, spans, spark.createDataFrame(chosen, "set_id int, tip string"))
    assert want and {tuple(x) for x in got.collect()} == want


def test_lifted_sums_lengths(spark, forest):
    rows, df = forest
    way, length = above(rows), {(t, c): x for t, _, c, x in rows}
    stops = {("A", "i2"), ("B", "i30"), ("B", "i58"), ("D", "i0"), ("D", "i40")}
    got = {(r.tree_id, r.node): (r.above, r.length, r.steps) for r in iv.lifted(df, spark.createDataFrame(sorted(stops), "tree_id string, node string")).collect()}
    for (t, x), w in way.items():
        if w:
            k = next((k for k, a in enumerate(w) if (t, a) in stops), None)
            n = len(w) if k is None else k + 1
            assert got[t, x] == (None if k is None else w[k], sum(length[t, y] for y in [x, *w][:n]), n)


def test_scans(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), f"{r.randrange(10**6)}", r.randint(-3, 9)) for _ in range(500)]
    rows = sorted({(k, o): (k, o, v) for k, o, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, o string, v long").repartition(5)
    assert [(x.k, x.o) for x in scans.numbered(df, ["k", "o"], "n").orderBy("n").collect()] == [x[:2] for x in rows]
    got = {(x.k, x.o): x.s for x in scans.running(df, ["k"], ["o"], F.col("v"), "s").collect()}
    for k, o, _ in rows:
        assert got[k, o] == sum(v for a, b, v in rows if a == k and b < o)


def test_rounds_go_with_the_logarithm(spark, monkeypatch):
    """A caterpillar of 3,000 levels: linear rows, and few tables."""
    made = []
    monkeypatch.setattr(iv, "stash", lambda df, name, f=iv.stash: made.append(name) or f(df, name))
    df = spark.range(3000).select(F.lit("T").alias("tree_id"), F.format_string("i%05d", "id").alias("parent"), F.explode(F.array(F.format_string("i%05d", F.col("id") + 1), F.format_string("t%05d", "id"))).alias("child"))
    spans = iv.intervals(df)
    assert spans.count() == 6001 and spans.agg(F.max("depth")).first()[0] == 3000 and len(made) < 20
    made.clear()
    assert iv.lifted(df).agg(F.max("steps")).first()[0] == 3000 and len(made) < 16


def test_transfer_distances_equal_all_pairs(spark):
    """Random trees over the same tips, some of them near stars."""
    r = random.Random(11)
    rows = []
    for t, k in (("A", 9), ("B", 14), ("C", 3)):
        nodes = ["i0"]
        for x in range(1, k):
            rows.append((t, r.choice(nodes), f"i{x}"))
            nodes.append(f"i{x}")
        rows += [(t, r.choice(nodes), f"t{x}") for x in range(24)]
        inner = {p for u, p, _ in rows if u == t}
        rows = [e for e in rows if e[0] != t or e[2][0] == "t" or e[2] in inner]
    df = spark.createDataFrame(rows, "tree_id string, parent string, child string").cache()
    clades = {}
    for (t, x), w in above([(*e, 0) for e in rows]).items():
        if x[0] == "t":
            for a in w[:-1]:
                clades.setdefault((t, a), set()).add(x)
    own = spark.createDataFrame([(t, a, x) for (t, a), v in clades.items() for x in v], "tree_id string, node string, tip string").cache()
    got = {(x.tree_id, x.node, x.other_tree): (x.light, x.distance) for x in su.transfer_distances(own, own, df).collect()}
    size = {t: len(set().union(*(v for (u, _), v in clades.items() if u == t))) for t in "ABC"}
    want = {}
    for (t, a), v in clades.items():
        for o in "ABC":
            if o != t:
                d = [len(v ^ w) for (u, _), w in clades.items() if u == o]
                want[t, a, o] = (min(len(v), size[t] - len(v)), min(min(x, size[t] - x) for x in d))
    assert got == want


def test_shallow_trees_get_the_places_of_the_tour_without_it(spark, forest, monkeypatch):
    """The same places both ways, and rows written that don't go with the rounds of list ranking."""
    _, df = forest
    df = df.where("tree_id IN ('A', 'C')")
    want = sorted(map(tuple, iv._toured(df).select("tree_id", "node", "enter", "leave", "first", "tips", "depth").collect()))
    monkeypatch.setattr(iv, "_toured", None)
    assert sorted(map(tuple, iv.intervals(df).select("tree_id", "node", "enter", "leave", "first", "tips", "depth").collect())) == want
    assert iv.intervals(df.limit(0)).count() == 0
