"""Ancestors' states by sums of each parent's own tips, and queries on trees that read the given tables once."""

import random

from phylomill import registry
from phylomill.operators import trees as tr

SF = "/root/testdata/sf0.001"


def test_states_equal_those_from_all_tips_below(spark):
    dice = random.Random(3)
    rows = [("a", f"n{dice.randrange(max(0, i - 3), i)}", f"n{i}") for i in range(1, 40)] + [("b", "r", f"n{i}") for i in range(5)]
    edges = spark.createDataFrame(rows, "tree_id string, parent string, child string")
    states = spark.createDataFrame([(f"n{i}", s, dice.randrange(3)) for i in range(40) for s in range(6) if dice.random() < 0.6], "tip string, site int, state int")
    want = tr.indel_ancestors(tr.clades(edges), states)
    got = tr.indel_states(edges, states)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_queries_read_the_given_tables_once(spark):
    for name in ("s66_branch_lengths", "s67_changes_per_site", "s68_origins", "s69_evolution_events"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "c_custkey" not in plan and "l_orderkey" not in plan
