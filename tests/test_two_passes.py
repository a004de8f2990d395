"""Ancestors' codes: tips are summed up in their parents once, and are in no table that is written after that."""

import random

import pytest

from phylomill.operators import trees as tr


@pytest.mark.parametrize("kind,codes", [("reversible", [1, 2, 3]), ("dna", [1, 2, 4, 8, 3, 16])])
def test_no_written_table_holds_the_tips(spark, monkeypatch, kind, codes):
    dice = random.Random(11)
    rows = [("a", "r", "x"), ("a", "x", "y"), ("a", "r", "t0")] + [("a", dice.choice("rxy"), f"t{i}") for i in range(1, 60)]
    edges = spark.createDataFrame(rows, "tree_id string, parent string, child string")
    tips = spark.createDataFrame([("a", f"t{i}", s, dice.choice(codes)) for i in range(60) for s in range(4) if dice.random() < 0.7], "tree_id string, tip string, site int, code int")
    depth = tr.levels(edges)
    assert {x.node: x.depth for x in depth.collect()} == {"r": 0, "x": 1, "y": 2} | {c: {"r": 1, "x": 2, "y": 3}[p] for _, p, c in rows if c[0] == "t"}
    written, write = [], tr.stash
    monkeypatch.setattr(tr, "stash", lambda df, name="table": written.append(out := write(df, name)) or out)
    find = tr.reversible_ancestors if kind == "reversible" else tr.dna_ancestors
    got = find(edges, tips, depth)
    assert max(x.count() for x in written) <= 3 * 4  # inner nodes by sites
    with monkeypatch.context() as m:
        m.setattr(tr, "DEEP", 0)  # contracted
        want = find(edges, tips, depth)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    parent = edges.withColumnRenamed("child", "tip")
    assert sorted(find(edges, tips.join(parent, ["tree_id", "tip"]), depth).collect()) == sorted(want.collect())
