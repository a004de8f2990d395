"""Trees that a query takes no row from are not unfolded."""

from phylomill import registry


def test_fitted_clades_look_at_two_trees(spark, monkeypatch):
    from phylomill.queries import support

    seen, members = [], support.members
    monkeypatch.setattr(support, "members", lambda e: seen.append(e.select("tree_id").distinct().count()) or members(e))
    registry.queries()["s93_fitted_clades"](spark, "/root/testdata/sf0.001")
    assert seen == [2]
