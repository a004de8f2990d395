import random

import pytest

from phylomill.operators import clusters as cl
from phylomill.operators import neighbors as nb
from phylomill.stash import stash


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=["one block", "many blocks"])
def forms(request, monkeypatch):
    """Small blocks, tiles, chunks of classes and batches of pairs, or all in one."""
    if request.param != "one block":
        for name, value in (("WIDE", 5), ("SMALL", 3), ("CHUNK", 2), ("ROWS", 7), ("CELLS", 40)):
            monkeypatch.setattr(nb, name, value)


def copies(spark, seed=5, n=60):
    """Tips with copies, tips below the radius and fractional weights."""
    r = random.Random(seed)
    weight = {m: 0.5 + r.randrange(16) / 16 for m in range(12)}
    sets = [sorted(r.sample(range(12), r.randint(1, 9))) for _ in range(18)]
    bags = {t: set(r.choice(sets)) for t in range(n)}
    df = spark.createDataFrame([(t, m, weight[m]) for t, bag in bags.items() for m in bag], "tip_id long, mut_id long, weight double")
    return bags, weight, df


def plain(bags, weight):
    return {(a, b): sum(weight[m] for m in bags[a] & bags[b]) for a in bags for b in bags if bags[a] & bags[b]}


def test_pairs_of_classes_are_those_of_their_tips(spark, forms, monkeypatch):
    """Without a shuffle of pairs, and without products of tips that have copies."""
    bags, weight, df = copies(spark)
    monkeypatch.setattr(nb, "_by_blocks", None)
    want = sorted((a, b, s) for (a, b), s in plain(bags, weight).items() if s >= 4)
    assert rows(nb.within_radius(df, 4.0)) == want and want
    two = df.crossJoin(spark.createDataFrame([(1,), (2,)], "rep_id int"))
    assert rows(nb.within_radius(two, 4.0, ["rep_id"])) == [(k, *x) for k in (1, 2) for x in want]


def test_nearest_of_classes_are_those_of_their_tips(spark, forms, monkeypatch):
    bags, weight, df = copies(spark)
    monkeypatch.setattr(nb, "shared_weights", None)
    near = plain(bags, {m: 1.0 for m in weight})
    for k, share in ((1, 0.0), (5, 0.6), (9, 0.4)):
        want = []
        for a in bags:
            mine = [(b, s) for (x, b), s in near.items() if x == a and s >= int(len(bags[a]) * share)]
            want += [(a, b, s) for b, s in mine if sum(t > s for _, t in mine) < k]
        assert rows(nb.nearest(nb.weighted(df.select("tip_id", "mut_id")), k, share)) == sorted(want) and want


def test_probe_counts_classes(spark, forms):
    bags, weight, df = copies(spark)
    picked = [a for a in bags if a % 7 == 0]
    got = nb.probe(df, 4.0, 7).first()
    assert (got.n_probed, got.mean_neighbors) == (len(picked), sum(s >= 4 for (a, _), s in plain(bags, weight).items() if a in picked) / len(picked))


@pytest.mark.parametrize("product", [0, 10**9])
@pytest.mark.parametrize("share,least,sqrt", [(0.8, 0, False), (0.6, 9, True)])
def test_links_of_classes_are_those_of_their_tips(spark, monkeypatch, product, share, least, sqrt):
    bags, weight, df = copies(spark, 7)
    monkeypatch.setattr(cl, "PRODUCT", product)
    want = rows(cl.links(stash(nb.within_radius(df, 5.0), "near"), share, None, least, sqrt))
    members, reps = nb.classes(df)
    near = nb.within_radius(nb.of_classes(reps), 5.0).join(nb.class_sizes(reps).withColumnRenamed("tip_id", "b"), "b")
    link, own = cl.class_links(stash(near, "near"), share, least, sqrt)
    assert rows(cl.spread_links(link, own, members)) == want and link.count() < len(want)
    alone = spark.createDataFrame(want, "i long, j long")
    assert rows(cl.spread_components(link, own, members)) == rows(cl.components(alone, df))
