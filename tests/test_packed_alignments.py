"""Alignments in words of sites: shares of the shorter sequence, and roots against outgroups."""

import random

from phylomill.operators import neighbors as nb
from phylomill.operators import outgroup as og
from phylomill.stash import stash


def _frame(spark, tips, code="code"):
    return spark.createDataFrame([(t, s, c) for t, row in tips.items() for s, c in row.items()], f"tip_id long, site int, {code} int")


def _tips(seed, n=24):
    r = random.Random(seed)
    kinds = [{s: r.choice([1, 2, 4, 8, 15, 16]) for s in range(r.choice([3, 17, 40, 90]))} for _ in range(6)]
    tips = {t: {s: c if r.random() < 0.95 else 8 for s, c in kinds[t % 6].items()} for t in range(n)}
    return tips | {n: {0: 16, 1: 16}}


def test_share_of_the_shorter_sequence(spark, monkeypatch):
    names, keep = [], nb.stash
    monkeypatch.setattr(nb, "stash", lambda df, name="table": names.append((name, dict(df.dtypes))) or keep(df, name))
    tips = _tips(3)
    known = {t: {s: c for s, c in row.items() if c & 15} for t, row in tips.items()}
    shared = {(a, b): sum(bool(c & known[b].get(s, 0)) for s, c in known[a].items()) for a in tips for b in tips}
    want = {p: n for p, n in shared.items() if n >= 5 and 10 * n >= 9 * min(len(known[p[0]]), len(known[p[1]]))}
    got = nb.dna_within_radius(_frame(spark, tips), 5, share=(9, 10)).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want
    assert [t["cells"] for name, t in names if name == "sequences"] == ["array<struct<place:int,word:bigint>>"]


def test_roots_against_outgroups_by_products(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("LETTERS", 100), ("SITES", 16), ("ROWS", 7)):
        monkeypatch.setattr(nb, name, value)
    tips, other = _tips(4), _tips(5)
    want = set()
    for a, x in tips.items():
        for b, y in other.items():
            n = sum(c in (1, 2, 4, 8) for c in x.values()) - sum(bool(c & y.get(s, 0) & 15) for s, c in x.items())
            want |= {(f"t{a}", b, n)} if n < 9 else set()
    roots = _frame(spark, tips, "state").selectExpr("concat('t', tip_id) AS tree_id", "'r' AS node", "site", "state")
    got = og.filtered(stash(roots), _frame(spark, other, "state"), 9, "dna")
    assert "array_intersect" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)
