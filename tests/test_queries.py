"""Registered queries against their SQL twins in DuckDB; EVERY=1 runs all that have one."""

import os

import duckdb
import pytest

from phylomill import registry

SF = "/root/testdata/sf0.001"
QUICK = ["s01_fasta_records", "s04_digit_matrix", "s06_jplace_placements", "s08_regularized", "s09_mutation_dictionary", "s09_packed_words", "s15_variable_sites", "s17_exact_duplicates", "s20_reinserted", "s21_radius_neighbors", "s22_dna_radius", "s23_nearest", "s36_neighbor_votes", "s52_stitched", "s58_vote_shares", "s59_placed_edges", "s75_closure", "s79_bootstrap_alignment", "s94_deferred_sets", "s18_containment", "s27_links", "s27_links_by_both_sizes", "s30_resplit", "s31_split_quality", "s46_binary_outgroup_filter", "s47_retained_nodes", "s50_layer_summary", "s57_outgroup_sample", "s61_rerooted", "s61_moved_breaks", "s80_noise_weights", "s93_fitted_clades"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()) if os.environ.get("EVERY") else QUICK)
def test_query_equals_its_twin(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_hierarchical_build_is_one_tree(spark):
    edges = registry.queries()["s51_hierarchical_build"](spark, SF).collect()
    children = [e.child for e in edges]
    parents = {e.parent for e in edges}
    tips = {c for c in children if c not in parents}
    assert len(children) == len(set(children)) and len(parents - set(children)) == 1
    assert all(t.startswith("t:") for t in tips) and len(edges) == 2 * len(tips) - 2


def test_rerooting_keeps_tips_and_total_length(spark):
    from pyspark.sql import functions as F

    from phylomill.operators import intervals, rooting, trees
    from phylomill.queries.trees import edges

    e = edges(spark, SF).where("tree_id = 'A'").cache()
    at = e.where("child LIKE 'n:%'").groupBy("tree_id").agg(F.min("child").alias("node"))
    new = rooting.rerooted(e, intervals.intervals(e), at).cache()
    tips = lambda x: {r.tip for r in trees.tips(x).collect()}
    assert tips(new) == tips(e)
    assert new.agg(F.sum("length")).first()[0] == e.agg(F.sum("length")).first()[0]
    assert trees.roots(new).first().root.startswith("root:n:")
