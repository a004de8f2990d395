"""Hand-made cases for the traps of each operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylomill.operators import characters as ch
from phylomill.operators import clusters as cl
from phylomill.operators import components as cc
from phylomill.operators import duplicates as du
from phylomill.operators import impute as im
from phylomill.operators import neighbors as nb
from phylomill.operators import outgroup as og
from phylomill.operators import rooting as ro
from phylomill.operators import solve as so
from phylomill.operators import support as su
from phylomill.operators import trees as tr
from phylomill.sources import fasta
from phylomill.sources import trees as ts


def rows(df):
    return sorted(map(tuple, df.collect()))


def cells(spark, table):
    return spark.createDataFrame([(t, s, x) for t, r in table.items() for s, x in enumerate(r) if x is not None], "tip_id long, site int, state int")


def test_containment_traps(spark):
    # 2 is a subset of the later 5; 3 equals 4 before a strict superset comes, so it stays; 6 chains to 5 through 2
    c = cells(spark, {2: [1, 2, None, None], 3: [9, 9, None, None], 4: [9, 9, None, None], 5: [1, 2, 3, None], 6: [1, None, None, None], 7: [9, 9, 9, None]})
    assert dict(rows(du.containing(c))) == {2: 5, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}


def test_exact_and_reinserted(spark):
    bits = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 1), (3, 1)], "tip_id long, site int")
    assert rows(du.exact(bits)) == [(1, 1), (2, 1), (3, 3)]
    e = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 2.0)], "parent string, child string, length double")
    d = spark.createDataFrame([("a", "a"), ("c", "a"), ("b", "b")], "tip string, rep string")
    assert rows(du.reinserted(e, d)) == [("d:a", "a", 0.0), ("d:a", "c", 0.0), ("r", "b", 2.0), ("r", "d:a", 1.0)]


def test_prefix_filter_equals_naive(spark):
    r = random.Random(1)
    data = sorted({(t, r.randint(0, 12) if r.random() < 0.7 else 0) for t in range(40) for _ in range(8)})
    weight = {m: r.randint(1, 4) / 2 for m in range(13)}
    df = spark.createDataFrame([(t, m, weight[m]) for t, m in data], "tip_id long, mut_id long, weight double")
    bags = {}
    for t, m in data:
        bags.setdefault(t, set()).add(m)
    for radius in (1.5, 4.0, 6.0):
        want = sorted((a, b, s) for a in bags for b in bags if (s := sum(weight[m] for m in bags[a] & bags[b])) >= radius)
        got = rows(nb.within_radius(df, radius))
        assert got == want
        for way in (nb._by_prefixes, nb._by_blocks):
            assert rows(way(df, radius, [])) == [x for x in want if x[0] <= x[1]]
            two = df.crossJoin(spark.createDataFrame([(1,), (2,)], "rep int"))
            assert rows(way(two, radius, ["rep"])) == [(k, *x) for k in (1, 2) for x in want if x[0] <= x[1]]
        assert {(a, b) for a, b, _ in got} == {(b, a) for a, b, _ in got}


def test_nearest_keeps_ties(spark):
    data = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 2), (5, 9)]
    df = nb.weighted(spark.createDataFrame(data, "tip_id long, mut_id long"))
    assert [x for x in rows(nb.nearest(df, 3)) if x[0] == 1] == [(1, 1, 2.0), (1, 2, 2.0), (1, 3, 1.0), (1, 4, 1.0)]


def test_link_needs_more_than_the_share(spark):
    near = spark.createDataFrame([(a, b) for a in (1, 2) for b in (1, 2)] + [(1, 3), (1, 4), (2, 5), (2, 6)], "a long, b long")
    assert rows(cl.links(near, 0.5)) == [] and rows(cl.links(near, 0.49)) == [(1, 2)]


def test_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (300, 300)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = chain + star
    r.shuffle(edges)
    got = dict(rows(cc.connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert all(got[i] == 0 for i in range(31)) and got[200] == got[150] == 100 and all(got[1000 + i] == 1000 for i in range(50))
    assert rows(cc.connected_components(spark.createDataFrame([], "u long, v long"))) == []


def test_votes(spark):
    c = cells(spark, {1: [None, None, None, None], 2: [3, 0, 1, None], 3: [3, 0, 2, None]})
    near = spark.createDataFrame([(a, b) for a in (1, 2, 3) for b in (1, 2, 3)], "a long, b long")
    assert rows(im.voted(c, near)) == [(1, 0, 3)]


def test_variable_sites(spark):
    data = {1: [1, 1, 15, 3], 2: [1, 16, 15, 12]}
    df = spark.createDataFrame([(t, s, c) for t, r in data.items() for s, c in enumerate(r)], "tip_id long, site int, code int")
    assert sorted({x[0] for x in rows(ch.variable_sites(df).select("site"))}) == [1, 3]


def test_fasta(spark):
    raw = spark.createDataFrame([(">  a desc\nAC\n\nG t",), ("empty\n",), ("b\nUNA-",)], "value string").coalesce(1)
    assert rows(fasta.records(raw)) == [(1, "a", "ACGt"), (2, "b", "UNA-")]
    codes = fasta.sites(fasta.records(raw)).where("name = 'b'").orderBy("site").collect()
    assert [c.code for c in codes] == [2, 15, 1, 16]
    bad = spark.createDataFrame([(">a\nAC",), ("b\nA",)], "value string")
    with pytest.raises(Exception, match="differ"):
        fasta.records(bad).collect()


def test_newick():
    assert sorted(ts.parsed("((a:1,'b b':2)x:0.5,c)r;")) == sorted([("x", "a", 1.0, None), ("x", "b b", 2.0, None), ("r", "x", 0.5, None), ("r", "c", None, None)])
    assert len(ts.parsed("((a{0}:1{1},b:2{2}),c:3{3});")) == 4


def edges(spark, pairs):
    return spark.createDataFrame([("T", p, c, 1.0) for p, c in pairs], "tree_id string, parent string, child string, length double")


TREE = [("r", "x"), ("r", "c"), ("x", "y"), ("x", "b"), ("y", "a1"), ("y", "a2")]


def test_closure_and_ancestors(spark):
    e = edges(spark, TREE)
    p = tr.closure(e)
    assert p.count() == 2 + 2 * 2 + 2 * 3
    assert {(n, s) for _, n, s in rows(tr.clade_sizes(tr.clades(e, p)))} == {("r", 4), ("x", 3), ("y", 2)}
    deep = edges(spark, [(str(i), str(i + 1)) for i in range(40)])
    assert tr.closure(deep).count() == 40 * 41 // 2
    s = spark.createDataFrame([("a1", 0, 5), ("a2", 0, 5), ("b", 0, 7), ("a1", 1, 3)], "tip string, site int, state int")
    got = {(n, site): x for _, n, site, x in rows(tr.indel_ancestors(tr.clades(e, p), s))}
    assert got == {("y", 0): 5, ("x", 0): 0, ("r", 0): 0, ("y", 1): 3, ("x", 1): 3, ("r", 1): 3}
    c = tr.collapsed(e, spark.createDataFrame([("T", "x"), ("T", "y")], "tree_id string, node string"))
    assert rows(c) == [("T", "r", "a1", 3.0), ("T", "r", "a2", 3.0), ("T", "r", "b", 2.0), ("T", "r", "c", 1.0)]
    assert {n: x for _, _, n, x in rows(tr.ultrametric(e))} == {"x": 1, "y": 1, "a1": 1, "a2": 1, "b": 2, "c": 3}


def test_level_passes(spark):
    e = edges(spark, TREE)
    p = tr.closure(e)
    codes = spark.createDataFrame([("T", "a1", 0, 1), ("T", "a2", 0, 2), ("T", "b", 0, 2), ("T", "c", 0, 1)], "tree_id string, tip string, site int, code int")
    got = {n: x for _, n, _, x in rows(tr.reversible_ancestors(e, codes, tr.levels(e)))}
    assert got == {"r": 1, "x": 2, "y": 2}
    dna = codes.withColumn("code", F.when(F.col("tip") == "c", 4).otherwise(F.col("code")))
    got = {n: x for _, n, _, x in rows(tr.dna_ancestors(e, dna, tr.levels(e)))}
    assert got == {"r": 6, "x": 2, "y": 2}


def test_support_of_a_tree_by_itself(spark):
    e = edges(spark, TREE)
    m = tr.clades(e).select("tree_id", "node", "tip")
    two = m.unionByName(m.withColumn("tree_id", F.lit("U")))
    for rooted in (True, False):
        keys = su.clade_keys(two, rooted)
        assert rows(su.robinson_foulds(keys))[0][2] == 0
    assert {(n, s) for n, _, s in rows(su.exact_support(su.clade_keys(two), "T"))} == {("x", 1), ("y", 1)}
    near = su.nearest_clades(su.clade_distances(two, two))
    assert all(r[3] == 1.0 for r in rows(su.approximate_support(near, 0.0)))


def test_greedy_join_recovers_a_conflict_free_tree(spark):
    # ((0,1),(2,3)),((4,5),(6,7)): each clade has a mutation of its own
    clades = [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1), (2, 3), (4, 5), (6, 7)]
    m = np.array([[1 if t in c else 0 for c in clades] for t in range(8)])
    parent, states = so.agglomerate(m)
    below = {i: {i} for i in range(8)}
    for i, p in enumerate(parent):
        if p >= 0:
            below.setdefault(p, set()).update(below[i])
    assert {frozenset(v) for v in below.values()} >= {frozenset(c) for c in clades}
    assert (states[-1] == 0).all()


def naive(matrix):
    live, out, new = {i: r for i, r in enumerate(matrix)}, [], len(matrix)
    while len(live) > 1:
        best = max(((sum(x == y > 0 for x, y in zip(live[i], live[j])), -i, -j) for i in live for j in live if i < j))
        i, j = -best[1], -best[2]
        out.append((i, j))
        live[new] = [y if x < 0 else (0 if y >= 0 and x != y else x) for x, y in zip(live.pop(i), live.pop(j))]
        new += 1
    return out


def test_greedy_join_equals_naive():
    r = np.random.default_rng(3)
    for _ in range(20):
        m = r.integers(-1, 4, (9, 6))
        parent, _ = so.agglomerate(m)
        got = [tuple(np.flatnonzero(parent == k)) for k in range(9, 17)]
        assert got == naive(m.tolist())


def test_containment_equals_naive(spark):
    r = random.Random(7)
    table = {t: [r.choice([None, None, 1, 2]) for _ in range(5)] for t in range(60)}
    sets = {t: {(i, x) for i, x in enumerate(v) if x is not None} for t, v in table.items()}
    sets = {t: v for t, v in sets.items() if v}
    points = {}
    for t, own in sets.items():
        first = min((o for o, other in sets.items() if o != t and own <= other), default=None)
        points[t] = first if first is not None and (first < t or len(sets[first]) > len(own)) else t
    want = {}
    for t in sets:
        at = t
        while points[at] != at:
            at = points[at]
        want[t] = at
    assert dict(rows(du.containing(cells(spark, table)))) == want


def plain_links(lists, share, least, sqrt):
    out = []
    for i in lists:
        for j in lists[i]:
            if i < j:
                m, n, k = len(lists[i]), len(lists[j]), len(lists[i] & lists[j])
                if k >= least and k > share * ((m * n) ** 0.5 if sqrt else min(m, n)):
                    out.append((i, j))
    return sorted(out)


def test_links_equal_naive_both_ways(spark, monkeypatch):
    r = random.Random(2)
    lists = {i: {i} for i in range(80)}
    for _ in range(900):
        i, j = r.randrange(80), r.randrange(80)
        if i // 20 == j // 20 or r.random() < 0.1:
            lists[i].add(j)
            lists[j].add(i)
    near = spark.createDataFrame([(i, j) for i in lists for j in lists[i]], "a long, b long").cache()
    for share, least, sqrt in ((0.5, 0, False), (0.4, 6, True), (0.0, 0, False)):
        want = plain_links(lists, share, least, sqrt)
        for product in (0, 10**9):
            monkeypatch.setattr(cl, "PRODUCT", product)
            assert want and rows(cl.links(near, share, None, least, sqrt)) == want, (share, product)


def test_advice_follows_the_bounds(spark):
    # (backbone, largest, bounds) -> step, valid
    cases = [((100, 90), (0, 0), 0, True), ((100, 90), (50, 0), -1, False), ((100, 90), (0, 80), 1, False), ((100, 90), (0, 95), 0, True), ((300, 90), (0, 0), -1, True), ((90, 300), (0, 0), 1, True), ((300, 290), (100, 100), -1, False)]
    for (top, low), bounds, step, valid in cases:
        q = spark.createDataFrame([(top, low)], "backbone long, largest long")
        got = cl.advice(q, 1.2, *bounds).first()
        assert (got.step, got.valid, got.balance) == (step, valid, (top + low) / 2), (top, low, bounds)


def test_radius_search_equals_the_rule(spark):
    """Three families of tips; the search is replayed with splits at every radius."""
    from phylomill.plans import lineage

    r = random.Random(3)
    rows_ = [(t, 100 * f + m) for f in range(3) for t in range(20 * f, 20 * f + 20) for m in range(12) if r.random() < 0.8] + [(t, 999 - t % 3) for t in range(60)]
    items = spark.createDataFrame(rows_, "tip_id long, mut_id long")
    radius, members, tried = lineage.automatic_split(items, 12, step=1, least=1, min_size=3)
    steps = [tuple(x) for x in tried.orderBy(F.desc("radius")).collect()]
    assert len(steps) > 2 and sum(x[-1] for x in steps) == 1 and radius == next(x[0] for x in steps if x[-1])
    for x in steps:
        own = {}
        for _, c in rows(lineage.split(stash_weighted(items), x[0], 0.8)):
            own[c] = own.get(c, 0) + 1
        big = [n for n in own.values() if n >= 3]
        assert (x[2], x[3]) == (len(big) + sum(n for n in own.values() if n < 3), max(own.values()))
    assert members.count() == 60


def stash_weighted(items):
    from phylomill.stash import stash

    return stash(nb.weighted(items), "items")


def test_conflicts_of_all_kinds(spark):
    r = random.Random(9)
    for kind, states in (("indel", [0, 1, 2]), ("binary", [1, 2]), ("dna", [1, 2, 4, 8, 3, 15, 16])):
        node = {s: r.choice(states) for s in range(30) if r.random() < 0.9}
        outs = {t: {s: r.choice(states) for s in range(30) if r.random() < 0.8} for t in range(12)}

        def n(o):
            if kind == "indel":
                return sum(x > 0 and s in o and o[s] != x for s, x in node.items())
            if kind == "binary":
                return sum(x == 2 and o.get(s) != 2 for s, x in node.items())
            meets = lambda s, x: s in o and x & o[s] & 15 != 0
            return sum(x in (1, 2, 4, 8) and not meets(s, x) for s, x in node.items()) - sum(x not in (1, 2, 4, 8, 16) and meets(s, x) for s, x in node.items())

        want = {t: n(o) for t, o in outs.items()}
        ns = spark.createDataFrame([("T", "R", s, x) for s, x in node.items()], "tree_id string, node string, site int, state int")
        o = spark.createDataFrame([(t, s, x) for t, c in outs.items() for s, x in c.items()], "tip_id long, site int, state int")
        pairs = spark.createDataFrame([("T", "R", t) for t in outs], "tree_id string, node string, tip_id long")
        assert {x.tip_id: x.n for x in og.conflicts(ns, o, pairs, kind).collect()} == want, kind
        cut = sorted(want.values())[6]
        assert {x.tip_id: x.n for x in og.filtered(ns, o, cut, kind).collect()} == {t: k for t, k in want.items() if k < cut}, kind


def test_outgroup_sample(spark):
    tips = spark.createDataFrame([(t,) for t in range(500)] * 2, "tip_id long")
    every = sorted((x.h, x.tip_id) for x in tips.distinct().select("tip_id", ro.scrambled(F.lit(1), F.col("tip_id")).alias("h")).collect())
    for n in (1, 77, 250, 500, 900):
        assert sorted(x.tip_id for x in ro.sampled_outgroups(tips, 0.0, n).collect()) == sorted(t for _, t in every[:n])
