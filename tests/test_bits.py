"""Bits of few sites as words."""

import random

from phylomill.operators import outgroup as og


def test_bits_are_words_or_arrays(spark, monkeypatch):
    dice = random.Random(4)
    sites = [0, 1, 31, 32, 62, 63, 64, 127, 128, 200]
    bags = {t: {s for s in sites if dice.random() < 0.6} for t in range(25)}
    cells = lambda i: [(t, s, 2 if s in bag else 1) for t, bag in bags.items() if i(t) for s in sites]
    out = spark.createDataFrame(cells(lambda t: True), "tip_id long, site int, state int")
    own = spark.createDataFrame([(str(t), "root", s, x) for t, s, x in cells(lambda t: t % 3 == 0)], "tree_id string, node string, site int, state int")
    want = sorted((str(a), b, len(bags[a] - bags[b])) for a in bags if a % 3 == 0 for b in bags if len(bags[a] - bags[b]) < 4)
    for most in (og.MOST_SITES, 200):
        with monkeypatch.context() as m:
            m.setattr(og, "MOST_SITES", most)
            got = og.filtered(own, out, 4, "binary")
            assert ("array_intersect" in got._jdf.queryExecution().optimizedPlan().toString()) == (most == 200)
            assert sorted(map(tuple, got.collect())) == want
