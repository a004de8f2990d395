"""Links between neighbour lists, looked up between blocks of lists."""

import math
import random

import pytest

from phylomill.operators import clusters as cl


def _rows(dice, n):
    """Lists of two keys, not all of them mutual, with sizes of the members."""
    size = [dice.randrange(1, 5) for _ in range(n)]
    return [(key, a, b, size[b]) for key in (1, 2) for a in range(n) for b in range(n) if a == b or (abs(a - b) < 9 and dice.random() < 0.8)]


@pytest.mark.parametrize("share, least, sqrt", [(0.8, 0, False), (0.6, 4, True), (0.0, 1, False)])
@pytest.mark.parametrize("limits", [(1 << 19, 1 << 14, 1 << 26), (150, 50, 300)])
def test_links_equal_brute_force(spark, monkeypatch, share, least, sqrt, limits):
    written = []
    for name, value in zip(("LISTED", "FEW", "MARKS"), limits):
        monkeypatch.setattr(cl, name, value)
    monkeypatch.setattr(cl, "PRODUCT", 0)
    stash = cl.stash
    monkeypatch.setattr(cl, "stash", lambda df, name="table": written.append(name) or stash(df, name))
    rows = _rows(random.Random(7), 40)
    lists = {}
    for key, a, b, size in rows:
        lists.setdefault((key, a), {})[b] = size
    want = set()
    for key, i, j, _ in rows:
        x, y = lists[key, i], lists[key, j]
        n, m = sum(x.values()), sum(y.values())
        common = sum(s for b, s in x.items() if b in y)
        if i < j and common >= least and common > share * (math.sqrt(n * m) if sqrt else min(n, m)):
            want.add((key, i, j))
    near = spark.createDataFrame(rows, "rep int, a long, b long, size long")
    got = cl.links(near, share, ["rep"], least, sqrt).select("rep", "i", "j").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert "candidates" not in written  # no row for a pair of lists and a member
