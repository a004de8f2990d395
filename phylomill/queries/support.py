"""Support, distances between trees, nested sets and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from phylomill import fixtures as fx
from phylomill.operators import consensus as co
from phylomill.operators import support as su
from phylomill.operators import trees as tr
from phylomill.queries.trees import CLO, edges, members, spans
from phylomill.registry import query
from phylomill.stash import stash

#: Clades as sorted tip lists; inner nodes without the root in ``q``.
SETS = f"{CLO}, z AS (SELECT tree_id, node, count(*) AS size, list(tip ORDER BY tip) AS tips FROM m GROUP BY 1, 2), q AS (SELECT * FROM z WHERE node <> 'R')"
DIST = f"""{SETS}, i AS (SELECT x.tree_id, x.node, y.tree_id AS other_tree, y.node AS other, count(*) AS k FROM m x JOIN m y ON x.tip = y.tip AND x.tree_id <> y.tree_id WHERE x.node <> 'R' AND y.node <> 'R' GROUP BY 1, 2, 3, 4),
d AS (SELECT i.tree_id, i.node, a.size, i.other_tree, i.other, b.size AS other_size, a.size + b.size - 2 * k AS distance FROM i JOIN q a ON a.tree_id = i.tree_id AND a.node = i.node JOIN q b ON b.tree_id = i.other_tree AND b.node = i.other)"""
NEAR = f"{DIST}, w AS (SELECT tree_id, node, size, other_tree, other, distance FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node, other_tree ORDER BY distance, other_size DESC, other DESC) AS r FROM d) x WHERE r = 1)"


def keys(spark, d):
    return stash(su.clade_keys(members(edges(spark, d))), "keys")


def inner(spark, d):
    return stash(members(edges(spark, d)).where("node != 'R'").select("tree_id", "node", "tip"), "clades")


def distances(spark, d):
    m = inner(spark, d)
    return su.clade_distances(m, m)


def nearest(spark, d):
    return stash(su.nearest_clades(distances(spark, d)), "nearest")


@query("s82_exact_support", f"{SETS} SELECT q.node, q.size, (SELECT count(DISTINCT o.tree_id) FROM z o WHERE o.tree_id <> 'A' AND o.tips = q.tips) AS support FROM q WHERE q.tree_id = 'A'")
def _(spark, d):
    return su.exact_support(keys(spark, d), "A")


@query("s83_robinson_foulds", f"""
{SETS}, u AS (SELECT DISTINCT tree_id, tips FROM z), n AS (SELECT tree_id, count(*) AS k FROM u GROUP BY 1)
SELECT a.tree_id AS x, b.tree_id AS y, a.k + b.k - 2 * (SELECT count(*) FROM u p JOIN u q ON p.tips = q.tips WHERE p.tree_id = a.tree_id AND q.tree_id = b.tree_id) AS distance,
CAST(a.k + b.k - 2 * (SELECT count(*) FROM u p JOIN u q ON p.tips = q.tips WHERE p.tree_id = a.tree_id AND q.tree_id = b.tree_id) AS DOUBLE) / (a.k + b.k) AS normalised FROM n a JOIN n b ON a.tree_id < b.tree_id""")
def _(spark, d):
    return su.robinson_foulds(keys(spark, d))


@query("s84_clade_distances", f"{DIST} SELECT tree_id, node, size, other_tree, other, other_size, distance FROM d")
def _(spark, d):
    return distances(spark, d)


@query("s84_nearest_clades", f"{NEAR} SELECT tree_id, node, size, other_tree, other, distance FROM w")
def _(spark, d):
    return su.nearest_clades(distances(spark, d))


@query("s86_approximate_support", f"{NEAR} SELECT tree_id, node, size, CAST(sum(CASE WHEN distance <= 0.1 * size THEN 1 ELSE 0 END) AS DOUBLE) / 3 AS support FROM w WHERE tree_id = 'A' GROUP BY 1, 2, 3")
def _(spark, d):
    n = nearest(spark, d)
    return su.approximate_support(n, 0.1).where("tree_id = 'A'")


@query("s87_mutual_support", f"{NEAR} SELECT tree_id, node, size, CAST(sum(CASE WHEN distance <= 0.05 * size THEN 1 ELSE 0 END) AS DOUBLE) / 3 AS support FROM w GROUP BY 1, 2, 3")
def _(spark, d):
    return su.approximate_support(nearest(spark, d), 0.05)


@query("s88_transfer_distances", f"""
{SETS}, n AS (SELECT tree_id, count(*) AS k FROM t GROUP BY 1), x AS (SELECT a.tree_id, a.node, a.size, n.k, b.tree_id AS other_tree, a.size + b.size - 2 * coalesce((SELECT count(*) FROM m u JOIN m v ON u.tip = v.tip WHERE u.tree_id = a.tree_id AND u.node = a.node AND v.tree_id = b.tree_id AND v.node = b.node), 0) AS d
FROM q a JOIN q b ON a.tree_id <> b.tree_id JOIN n ON n.tree_id = a.tree_id)
SELECT tree_id, node, least(size, k - size) AS light, other_tree, min(least(d, k - d)) AS distance FROM x GROUP BY 1, 2, size, k, other_tree""")
def _(spark, d):
    m = inner(spark, d)
    return su.transfer_distances(m, m, edges(spark, d))


def _consensus() -> str:
    """The four trees one after the other."""
    out = f"{NEAR}, sup AS (SELECT tree_id, node, size FROM w GROUP BY 1, 2, 3 HAVING 2 * (sum(CASE WHEN distance <= 0.1 * size THEN 1 ELSE 0 END) + 1) > 4), nn AS (SELECT * FROM w WHERE distance <= 0.1 * size), kA AS (SELECT * FROM sup WHERE tree_id = 'A')"
    for last, t in zip("ABC", "BCD"):
        out += f", k{t} AS (SELECT * FROM k{last} UNION ALL SELECT s.* FROM sup s WHERE s.tree_id = '{t}' AND NOT EXISTS (SELECT 1 FROM k{last} k JOIN nn ON nn.tree_id = k.tree_id AND nn.node = k.node WHERE nn.other_tree = '{t}' AND nn.other = s.node))"
    return out + " SELECT tree_id, node, size FROM kD"


@query("s89_consensus_clades", _consensus())
def _(spark, d):
    return co.consensus_clades(nearest(spark, d), 0.1, co.ordered(edges(spark, d)))


_FLAG = "f AS (SELECT tree_id, child AS node FROM e WHERE length = 2 AND child NOT LIKE 't:%')"


@query("s90_maximal_flagged", f"""
{CLO}, {_FLAG}, b AS (SELECT tree_id, child AS node FROM e WHERE parent = 'R')
SELECT p.tree_id, b.node AS top, p.node FROM p JOIN b ON b.tree_id = p.tree_id AND b.node = p.ancestor JOIN f ON f.tree_id = p.tree_id AND f.node = p.node
WHERE NOT EXISTS (SELECT 1 FROM p y JOIN f g ON g.tree_id = y.tree_id AND g.node = y.ancestor JOIN p v ON v.tree_id = y.tree_id AND v.node = y.ancestor AND v.ancestor = b.node WHERE y.tree_id = p.tree_id AND y.node = p.node)""")
def _(spark, d):
    e = edges(spark, d)
    return su.maximal_flagged(e, e.where("length = 2 AND child NOT LIKE 't:%'").select("tree_id", F.col("child").alias("node")), e.where("parent = 'R'").select("tree_id", F.col("child").alias("node")))


_CHOSEN = "SELECT c_custkey % 4 AS k, concat('t:', CAST(c_custkey AS STRING)) AS tip, concat('x', CAST(c_nationkey % 3 AS STRING)) AS set_id FROM {customer}"


@query("s91_maximal_nested", f"""
{CLO}, c AS (SELECT tip, set_id FROM ({_CHOSEN}) q), z AS (SELECT tree_id, node, count(*) AS size FROM m GROUP BY 1, 2),
i AS (SELECT m.tree_id, c.set_id, m.node, z.size FROM m JOIN c ON c.tip = m.tip JOIN z ON z.tree_id = m.tree_id AND z.node = m.node GROUP BY 1, 2, 3, 4 HAVING count(*) = z.size)
SELECT tree_id, set_id, node, size FROM i WHERE NOT EXISTS (SELECT 1 FROM e JOIN i j ON j.tree_id = e.tree_id AND j.node = e.parent AND j.set_id = i.set_id WHERE e.tree_id = i.tree_id AND e.child = i.node)""")
def _(spark, d):
    e = edges(spark, d)
    return su.maximal_nested(e, spans(e), fx.table(spark, d, _CHOSEN).select("tip", "set_id"))


@query("s92_unnested_nodes", f"{CLO}, {_FLAG} SELECT f.tree_id, f.node FROM f WHERE NOT EXISTS (SELECT 1 FROM p JOIN f g ON g.tree_id = p.tree_id AND g.node = p.ancestor WHERE p.tree_id = f.tree_id AND p.node = f.node)")
def _(spark, d):
    e = edges(spark, d)
    return tr.topmost(e, e.where("length = 2 AND child NOT LIKE 't:%'").select("tree_id", F.col("child").alias("node")))


def _fitted() -> str:
    """Tree A has four levels, so the search ends after as many."""
    out = f"""{CLO}, ae AS (SELECT parent AS up, child FROM e WHERE tree_id = 'A'), ow AS (SELECT node AS child, tip FROM m WHERE tree_id = 'A' UNION ALL SELECT tip, tip FROM t WHERE tree_id = 'A'),
st AS (SELECT node AS set_id, tip FROM m WHERE tree_id = 'D' AND node LIKE 'n:%'), to_ AS (SELECT set_id, count(*) AS n FROM st GROUP BY 1), sz AS (SELECT child, count(*) AS m FROM ow GROUP BY 1),
ins AS (SELECT st.set_id, ow.child, ae.up, sz.m, count(*) AS i FROM ow JOIN st ON st.tip = ow.tip JOIN sz ON sz.child = ow.child JOIN ae ON ae.child = ow.child GROUP BY 1, 2, 3, 4),
now0 AS (SELECT set_id, n, 'R' AS up FROM to_)"""
    for r in range(5):
        out += f""", here{r} AS (SELECT now{r}.n, ins.* FROM now{r} JOIN ins ON ins.set_id = now{r}.set_id AND ins.up = now{r}.up),
fits{r} AS (SELECT set_id FROM here{r} WHERE m <= 2 * i GROUP BY set_id, n HAVING n + sum(m) - 2 * sum(i) <= 0.2 * n),
found{r} AS (SELECT set_id, up, child FROM here{r} WHERE m <= 2 * i AND set_id IN (SELECT set_id FROM fits{r})),
now{r + 1} AS (SELECT set_id, n, child AS up FROM here{r} WHERE i >= (1 - 0.2) * n AND set_id NOT IN (SELECT set_id FROM fits{r}) AND child IN (SELECT up FROM ae))"""
    return out + " " + " UNION ALL ".join(f"SELECT set_id, up AS \"at\", child FROM found{r}" for r in range(5))


@query("s93_fitted_clades", _fitted())
def _(spark, d):
    e = edges(spark, d).where("tree_id IN ('A', 'D')")
    m = stash(members(e), "clades")
    sets = m.where("tree_id = 'D' AND node LIKE 'n:%'").select(F.col("node").alias("set_id"), "tip")
    return co.fitted(e.where("tree_id = 'A'"), m.where("tree_id = 'A'"), sets, 0.2)


_SETS = "SELECT DISTINCT concat('o', CAST(o_orderkey AS STRING)) AS set_id, CAST(l_partkey AS STRING) AS node FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"


@query("s94_deferred_sets", f"""
WITH s AS ({_SETS}), z AS (SELECT set_id, count(*) AS k FROM s GROUP BY 1), w AS (SELECT s.node, s.set_id, row_number() OVER (PARTITION BY s.node ORDER BY z.k DESC, s.set_id) AS r FROM s JOIN z ON z.set_id = s.set_id)
SELECT DISTINCT set_id FROM w WHERE r > 1""")
def _(spark, d):
    return su.deferred(fx.table(spark, d, _SETS))


@query("s95_consensus_tree")
def _(spark, d):
    e = edges(spark, d)
    m = stash(members(e), "clades")
    return co.consensus_tree(e, m, co.consensus_clades(nearest(spark, d), 0.1, co.ordered(e)), "A", 0.2)


@query("s96_clones", f"""
{NEAR}, g AS (SELECT tree_id, node FROM w GROUP BY tree_id, node, size HAVING sum(CASE WHEN distance <= 0.1 * size THEN 1 ELSE 0 END) = 3)
SELECT g.tree_id, g.node FROM g WHERE NOT EXISTS (SELECT 1 FROM p JOIN g h ON h.tree_id = p.tree_id AND h.node = p.ancestor WHERE p.tree_id = g.tree_id AND p.node = g.node)""")
def _(spark, d):
    s = su.approximate_support(nearest(spark, d), 0.1)
    e = edges(spark, d)
    return su.clones(e, s, tr.roots(e), 1.0)
