"""Closure, ancestors, lengths, shaping, outgroups on trees and rooting."""

from __future__ import annotations

from pyspark.sql import functions as F

from phylomill import fixtures as fx
from phylomill.operators import intervals as iv
from phylomill.operators import outgroup as og
from phylomill.operators import resample as rs
from phylomill.operators import rooting as ro
from phylomill.operators import trees as tr
from phylomill.registry import query
from phylomill.stash import stash

EDGES, STATES = fx.TREE_EDGES, fx.TIP_STATES
CLO = f"""
WITH RECURSIVE e AS ({EDGES}),
p AS (SELECT tree_id, parent AS ancestor, child AS node, 1 AS distance FROM e UNION ALL SELECT p.tree_id, p.ancestor, e.child, p.distance + 1 FROM p JOIN e ON p.tree_id = e.tree_id AND p.node = e.parent),
t AS (SELECT tree_id, child AS tip FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.tree_id = e.tree_id AND f.parent = e.child)),
m AS (SELECT p.tree_id, p.ancestor AS node, p.node AS tip, p.distance FROM p JOIN t ON t.tree_id = p.tree_id AND t.tip = p.node),
s AS ({STATES})"""
#: Node states by the indel rule, tips included.
ALL = f"""{CLO},
a AS (SELECT tree_id, node, site, CASE WHEN min(state) = max(state) THEN min(state) ELSE 0 END AS state FROM m JOIN s ON s.tip = m.tip GROUP BY 1, 2, 3),
n AS (SELECT tree_id, node, site, state FROM a UNION ALL SELECT t.tree_id, t.tip, s.site, s.state FROM t JOIN s ON s.tip = t.tip)"""
CHANGED = f"{ALL}, c AS (SELECT e.tree_id, e.parent, e.child, x.site, x.state AS s_parent, y.state AS s_child FROM e JOIN n x ON x.tree_id = e.tree_id AND x.node = e.parent JOIN n y ON y.tree_id = e.tree_id AND y.node = e.child AND y.site = x.site WHERE x.state <> y.state)"


def edges(spark, d):
    """Written: made of sixteen selections, and read many times by a query."""
    return stash(fx.table(spark, d, EDGES), "edges")


def states(spark, d):
    """Written: a join of the largest tables."""
    return stash(fx.table(spark, d, STATES), "tip-states")


def both(spark, d):
    return edges(spark, d), states(spark, d)


def spans(e):
    return stash(iv.intervals(e), "spans")


def members(e):
    return tr.clades(e, stash(tr.closure(e), "closure"))


def node_states(e, s):
    own = tr.tips(e).join(s, "tip").select("tree_id", F.col("tip").alias("node"), "site", "state")
    return stash(tr.indel_states(e, s).unionByName(own), "states")


def changed(e, s):
    return stash(tr.changes(e, node_states(e, s)), "changed")


@query("s75_closure", f"{CLO} SELECT tree_id, ancestor, node, distance FROM p")
def _(spark, d):
    return tr.closure(edges(spark, d))


@query("s75_clade_sizes", f"{CLO} SELECT tree_id, node, count(*) AS size FROM m GROUP BY 1, 2")
def _(spark, d):
    return iv.sizes(spans(edges(spark, d)))


@query("s62_indel_ancestors", f"{ALL} SELECT tree_id, node, site, state FROM a")
def _(spark, d):
    return tr.indel_states(*both(spark, d))


@query("s63_binary_ancestors", f"{CLO}, z AS (SELECT tree_id, node, count(*) AS k FROM m GROUP BY 1, 2) SELECT m.tree_id, m.node, s.site FROM m JOIN s ON s.tip = m.tip JOIN z ON z.tree_id = m.tree_id AND z.node = m.node GROUP BY 1, 2, 3, z.k HAVING count(*) = z.k")
def _(spark, d):
    return tr.binary_ancestors(members(edges(spark, d)), states(spark, d).select("tip", "site"))


def _by_level(rule: str, gap: str) -> str:
    """Two passes over trees of known depth: tips at the bottom, five levels at most."""
    out = f"{CLO}, l AS (SELECT tree_id, node, max(distance) AS depth FROM p GROUP BY 1, 2 UNION ALL SELECT DISTINCT tree_id, 'R', 0 FROM e), k AS (SELECT t.tree_id, t.tip AS node, s.site, {gap} AS code FROM t JOIN s ON s.tip = t.tip)"
    known = "SELECT * FROM k"
    for h in (3, 2, 1, 0):
        out += f", u{h} AS (SELECT e.tree_id, e.parent AS node, q.site, {rule} AS code FROM e JOIN l ON l.tree_id = e.tree_id AND l.node = e.parent AND l.depth = {h} JOIN ({known}) q ON q.tree_id = e.tree_id AND q.node = e.child GROUP BY 1, 2, 3)"
        known += f" UNION ALL SELECT * FROM u{h}"
    return out


def _down(settle: str, root: str) -> str:
    out = f", d0 AS (SELECT tree_id, node, site, {root} AS code FROM u0)"
    for h in (1, 2, 3):
        out += f", d{h} AS (SELECT u.tree_id, u.node, u.site, {settle} AS code FROM u{h} u JOIN e ON e.tree_id = u.tree_id AND e.child = u.node JOIN d{h - 1} v ON v.tree_id = u.tree_id AND v.node = e.parent AND v.site = u.site)"
    return out + " SELECT tree_id, node, site, CAST(code AS INT) AS code FROM d0 UNION ALL SELECT tree_id, node, site, CAST(code AS INT) FROM d1 UNION ALL SELECT tree_id, node, site, CAST(code AS INT) FROM d2 UNION ALL SELECT tree_id, node, site, CAST(code AS INT) FROM d3"


def _codes(spark, d, code):
    e, s = both(spark, d)
    at = e.withColumnRenamed("child", "tip").join(tr.tips(e), ["tree_id", "tip"], "left_semi")
    rows = at.join(s, "tip").select("tree_id", "parent", "tip", "site", code.cast("int").alias("code"))
    return e, rows, tr.levels(e)


@query("s64_reversible_ancestors", _by_level("CASE WHEN bit_and(q.code) = 0 THEN 3 ELSE bit_and(q.code) END", "CASE WHEN state > 2 THEN 2 ELSE 1 END") + _down("CASE WHEN u.code <> 3 THEN u.code ELSE v.code END", "CASE WHEN code <> 3 THEN code ELSE 1 END"))
def _(spark, d):
    return tr.reversible_ancestors(*_codes(spark, d, F.when(F.col("state") > 2, 2).otherwise(1)))


@query("s65_dna_ancestors", _by_level("CASE WHEN bit_and(q.code) <> 0 THEN bit_and(q.code) ELSE bit_or(q.code) END", "CAST(1 AS INT) << state") + _down("CASE WHEN u.code & v.code <> 0 THEN u.code & v.code ELSE u.code END", "code"))
def _(spark, d):
    return tr.dna_ancestors(*_codes(spark, d, F.expr("shiftleft(1, state)")))


@query("s66_branch_lengths", f"{CHANGED} SELECT e.tree_id, e.parent, e.child, count(c.site) AS length FROM e LEFT JOIN c ON c.tree_id = e.tree_id AND c.child = e.child GROUP BY 1, 2, 3")
def _(spark, d):
    e, s = both(spark, d)
    return tr.branch_lengths(e, changed(e, s))


@query("s67_changes_per_site", f"{CHANGED} SELECT tree_id, site, count(*) AS n FROM c GROUP BY 1, 2")
def _(spark, d):
    return tr.changes_per_site(changed(*both(spark, d)))


GAINED = f"{ALL}, g AS (SELECT e.tree_id, e.child, y.site, y.state FROM e JOIN n y ON y.tree_id = e.tree_id AND y.node = e.child WHERE y.state > 0 AND NOT EXISTS (SELECT 1 FROM n x WHERE x.tree_id = e.tree_id AND x.node = e.parent AND x.site = y.site AND x.state = y.state))"


@query("s68_gained_mutations", f"{GAINED} SELECT tree_id, child, site, state FROM g")
def _(spark, d):
    e, s = both(spark, d)
    return tr.gained(e, node_states(e, s))


@query("s68_origins", f"{GAINED} SELECT tree_id, site, state, count(*) AS n FROM g GROUP BY 1, 2, 3")
def _(spark, d):
    e, s = both(spark, d)
    return tr.origins(tr.gained(e, node_states(e, s)))


@query("s69_evolution_events", f"{CHANGED} SELECT tree_id, count(*) AS events, CAST(sum(1 + site % 2) AS BIGINT) AS weighted FROM c GROUP BY 1")
def _(spark, d):
    e, s = both(spark, d)
    weights = s.select("site").distinct().withColumn("weight", (1 + F.col("site") % 2).cast("long"))
    return tr.events(changed(e, s), weights)


@query("s67_inner_changes_per_site", f"{CHANGED} SELECT tree_id, site, count(*) AS n FROM c WHERE child NOT LIKE 't:%' AND s_parent <> 4 AND s_child <> 4 GROUP BY 1, 2")
def _(spark, d):
    """Changes on edges to inner nodes; state 4 stands for a gap."""
    e, s = both(spark, d)
    return tr.changes_per_site(changed(e, s), e.select("tree_id", F.col("parent").alias("node")), 4)


@query("s81_homoplasy_weights", f"{GAINED}, o AS (SELECT tree_id, site, state, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT tree_id, site, state, round(1.0E0 / n / avg(1.0E0 / n) OVER (PARTITION BY tree_id), 9) AS weight FROM o")
def _(spark, d):
    e, s = both(spark, d)
    o = stash(tr.origins(tr.gained(e, node_states(e, s))), "origins")
    return rs.homoplasy_weights(o).withColumn("weight", F.round("weight", 9))


_DROP = "child LIKE 'n:%' AND length = 1"
_COLLAPSED = """
x AS (SELECT tree_id, child AS node FROM e WHERE {drop}),
u AS (SELECT p.tree_id, p.node, min(p.distance) AS distance FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.tree_id = p.tree_id AND x.node = p.ancestor) GROUP BY 1, 2)
SELECT e.tree_id, q.ancestor AS parent, e.child, e.length + coalesce((SELECT sum(f.length) FROM p r JOIN e f ON f.tree_id = r.tree_id AND f.child = r.ancestor WHERE r.tree_id = e.tree_id AND r.node = e.child AND r.distance < u.distance), 0) AS length
FROM e JOIN u ON u.tree_id = e.tree_id AND u.node = e.child JOIN p q ON q.tree_id = e.tree_id AND q.node = e.child AND q.distance = u.distance
WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.tree_id = e.tree_id AND x.node = e.child)"""


@query("s70_collapsed", CLO + "," + _COLLAPSED.replace("{drop}", "child LIKE 'n:%' AND length = 3"))
def _(spark, d):
    e = edges(spark, d)
    return tr.collapsed(e, e.where("child LIKE 'n:%' AND length = 3").select("tree_id", F.col("child").alias("node")))


@query("s72_collapsed_by_support", CLO + "," + _COLLAPSED.replace("{drop}", "substring(child, 1, 1) IN ('n', 's', 'g', 'm') AND length(child) % 4 < 2"))
def _(spark, d):
    e = edges(spark, d)
    support = e.where("substring(child, 1, 1) IN ('n', 's', 'g', 'm')").select("tree_id", F.col("child").alias("node"), ((F.length("child") % 4) / 4).alias("support"))
    return tr.collapsed_by_support(e, support, 0.5)


@query("s73_ultrametric", f"""
{CLO}, z AS (SELECT t.tree_id, t.tip, e.length + coalesce(sum(f.length), 0) AS depth FROM t JOIN e ON e.tree_id = t.tree_id AND e.child = t.tip LEFT JOIN p ON p.tree_id = t.tree_id AND p.node = t.tip LEFT JOIN e f ON f.tree_id = p.tree_id AND f.child = p.ancestor GROUP BY 1, 2, e.length)
SELECT e.tree_id, e.parent, e.child, e.length + coalesce((SELECT max(y.depth) FROM z y WHERE y.tree_id = e.tree_id) - z.depth, 0) AS length FROM e LEFT JOIN z ON z.tree_id = e.tree_id AND z.tip = e.child""")
def _(spark, d):
    return tr.ultrametric(edges(spark, d))


@query("s74_ordered_tips", f"{CLO} SELECT t.tree_id, t.tip, CAST(row_number() OVER (PARTITION BY t.tree_id ORDER BY c.c_custkey DESC) AS INT) AS place FROM t JOIN {{customer}} c ON concat('t:', CAST(c.c_custkey AS STRING)) = t.tip")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("t:"), "c_custkey").alias("tip"), (-F.col("c_custkey")).alias("place"))
    return tr.ordered_tips(edges(spark, d), c)


@query("s77_pure_nodes", f"{CLO} SELECT m.tree_id, m.node, CASE WHEN min(c.c_mktsegment) = max(c.c_mktsegment) THEN min(c.c_mktsegment) ELSE '0' END AS identity FROM m JOIN {{customer}} c ON concat('t:', CAST(c.c_custkey AS STRING)) = m.tip GROUP BY 1, 2")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("t:"), "c_custkey").alias("tip"), F.col("c_mktsegment").alias("label"))
    return tr.pure_nodes(members(edges(spark, d)), c)


@query("s39_states_from_ancestors", f"""
{ALL}, f AS (SELECT m.tip, a.site, min(m.distance) AS distance FROM m JOIN a ON a.tree_id = m.tree_id AND a.node = m.node WHERE m.tree_id = 'A' GROUP BY 1, 2)
SELECT tip, site, state FROM s WHERE tip IN (SELECT tip FROM t WHERE tree_id = 'A') UNION ALL
SELECT f.tip, f.site, a.state FROM f JOIN m ON m.tip = f.tip AND m.distance = f.distance AND m.tree_id = 'A' JOIN a ON a.tree_id = 'A' AND a.node = m.node AND a.site = f.site
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.tip = f.tip AND s.site = f.site)""")
def _(spark, d):
    from phylomill.operators.impute import from_parents

    e, s = edges(spark, d).where("tree_id = 'A'"), states(spark, d)
    own = s.join(tr.tips(e).select("tip"), "tip", "left_semi")
    return from_parents(e, own, tr.indel_states(e, s))


_OUT = f"SELECT CAST(tip_id AS BIGINT) AS tip_id, site, state FROM ({fx.CHARACTERS}) c"


@query("s45_conflicts", f"""
{ALL}, o AS (SELECT tip_id, site, state FROM ({_OUT}) q WHERE tip_id % 50 = 0), i AS (SELECT DISTINCT tree_id, node FROM a), r AS (SELECT i.tree_id, i.node, w.tip_id FROM i CROSS JOIN (SELECT DISTINCT tip_id FROM o) w)
SELECT r.tree_id, r.node, r.tip_id, (SELECT count(*) FROM a JOIN o ON o.site = a.site WHERE a.tree_id = r.tree_id AND a.node = r.node AND o.tip_id = r.tip_id AND a.state > 0 AND a.state <> o.state) AS n FROM r""")
def _(spark, d):
    """Every tip whose id is divisible by 50 is held against every inner node."""
    a = stash(tr.indel_states(*both(spark, d)), "ancestors")
    out = fx.table(spark, d, _OUT).where("tip_id % 50 = 0")
    return og.conflicts(a, out, a.select("tree_id", "node").distinct().crossJoin(out.select("tip_id").distinct()))


@query("s49_subtrees", f"{CLO} SELECT e.tree_id, p.ancestor AS subtree, e.parent, e.child, e.length FROM e JOIN p ON p.tree_id = e.tree_id AND p.node = e.child WHERE p.ancestor LIKE 'n:%'")
def _(spark, d):
    e = edges(spark, d)
    return tr.subtree(e, spans(e), e.where("child LIKE 'n:%'").select("tree_id", F.col("child").alias("node")))


_STITCH = f"e AS (SELECT parent, child, CAST(1 + length(child) % 3 AS DOUBLE) AS length FROM ({fx.TREE_A}) t)"


@query("s52_stitched", f"WITH {_STITCH} SELECT parent, CASE WHEN child LIKE 's:%' THEN concat('r', child) ELSE child END AS child, length FROM e WHERE child NOT LIKE 't:%' UNION ALL SELECT concat('r', parent), child, length FROM e WHERE child LIKE 't:%'")
def _(spark, d):
    e = edges(spark, d).where("tree_id = 'A'")
    root = F.concat(F.lit("r"), F.col("parent"))
    parts = e.where("child LIKE 't:%'").select(F.col("parent").alias("pseudo"), root.alias("root"), root.alias("parent"), "child", "length")
    return tr.stitched(e.where("child NOT LIKE 't:%'"), parts)


@query("s53_leaf_sets", f"{CLO} SELECT node AS cluster_id, tip FROM m WHERE tree_id = 'A'")
def _(spark, d):
    e = edges(spark, d).where("tree_id = 'A'")
    return og.leaf_sets(e.where("child NOT LIKE 't:%'").select("parent", "child"), e.where("child LIKE 't:%'").select(F.col("parent").alias("cluster_id"), F.col("child").alias("tip")))


_N = f"{ALL}, k AS (SELECT tree_id, node, site, CAST(1 AS INT) << CAST(state % 4 AS INT) AS code FROM n), ec AS (SELECT e.tree_id, e.child, x.site, x.code | y.code AS code FROM e JOIN k x ON x.tree_id = e.tree_id AND x.node = e.parent JOIN k y ON y.tree_id = e.tree_id AND y.node = e.child AND y.site = x.site)"


def edge_codes(spark, d):
    e, s = both(spark, d)
    k = node_states(e, s).select("tree_id", "node", "site", F.expr("shiftleft(1, CAST(state % 4 AS INT))").alias("code"))
    return ro.edge_states(e, k)


@query("s55_edge_states", f"{_N} SELECT tree_id, child, site, CAST(code AS INT) AS code FROM ec")
def _(spark, d):
    return edge_codes(spark, d)


@query("s56_root_votes", f"""
{_N}, o AS (SELECT tip_id, site, CAST(1 AS INT) << CAST(state % 4 AS INT) AS code FROM ({_OUT}) q WHERE tip_id % 50 = 0),
v AS (SELECT ec.tree_id, o.tip_id, ec.child, count(CASE WHEN ec.code & o.code & 15 <> 0 THEN 1 END) AS shared FROM ec JOIN o ON o.site = ec.site GROUP BY 1, 2, 3)
SELECT tree_id, tip_id, child, shared FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, tip_id ORDER BY shared DESC, child) AS r FROM v) x WHERE r = 1""")
def _(spark, d):
    """Every tip whose id is divisible by 50 votes among the edges of every tree."""
    o = fx.table(spark, d, _OUT).where("tip_id % 50 = 0").select("tip_id", "site", F.expr("shiftleft(1, CAST(state % 4 AS INT))").alias("code"))
    return ro.root_votes(stash(edge_codes(spark, d), "edge-codes"), o)


@query("s60_unbroken", f"""
{CLO}, b AS (SELECT tree_id, child AS node FROM e WHERE child LIKE 's:%' AND length = 2), k AS (SELECT tree_id, node FROM b UNION SELECT p.tree_id, p.ancestor FROM p JOIN b ON b.tree_id = p.tree_id AND b.node = p.node)
SELECT e.tree_id, e.child AS node FROM e WHERE EXISTS (SELECT 1 FROM k WHERE k.tree_id = e.tree_id AND k.node = e.parent) AND NOT EXISTS (SELECT 1 FROM k WHERE k.tree_id = e.tree_id AND k.node = e.child)""")
def _(spark, d):
    e = edges(spark, d)
    return ro.unbroken(e, spans(e), e.where("child LIKE 's:%' AND length = 2").select("tree_id", F.col("child").alias("node")))


_AT = f"""
{CLO}, nr AS (SELECT tree_id, min(child) AS node FROM e WHERE child LIKE 'n:%' OR child LIKE 'm:%' GROUP BY 1), way AS (SELECT p.tree_id, p.ancestor AS node FROM p JOIN nr ON nr.tree_id = p.tree_id AND nr.node = p.node),
off AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM way w WHERE w.tree_id = e.tree_id AND w.node = e.child) AND NOT EXISTS (SELECT 1 FROM nr WHERE nr.tree_id = e.tree_id AND nr.node = e.child)),
q AS (SELECT tree_id, parent, child, length FROM off
  UNION ALL SELECT e.tree_id, e.child, e.parent, e.length FROM e JOIN way w ON w.tree_id = e.tree_id AND w.node = e.child
  UNION ALL SELECT e.tree_id, concat('root:', e.child), e.child, e.length / 2 FROM e JOIN nr ON nr.tree_id = e.tree_id AND nr.node = e.child
  UNION ALL SELECT e.tree_id, concat('root:', e.child), e.parent, e.length / 2 FROM e JOIN nr ON nr.tree_id = e.tree_id AND nr.node = e.child),
lone AS (SELECT tree_id, min(child) AS low, min(length) AS extra FROM q WHERE parent = 'R' GROUP BY 1 HAVING count(*) = 1)"""


def new_roots(spark, d):
    e = edges(spark, d)
    return e, e.where("child LIKE 'n:%' OR child LIKE 'm:%'").groupBy("tree_id").agg(F.min("child").alias("node"))


@query("s61_rerooted", f"{_AT} SELECT q.tree_id, q.parent, CASE WHEN q.child = 'R' THEN coalesce(l.low, q.child) ELSE q.child END AS child, q.length + CASE WHEN q.child = 'R' THEN coalesce(l.extra, 0) ELSE 0 END AS length FROM q LEFT JOIN lone l ON l.tree_id = q.tree_id WHERE NOT (q.parent = 'R' AND l.tree_id IS NOT NULL)")
def _(spark, d):
    e, at = new_roots(spark, d)
    return ro.rerooted(e, spans(e), at)


@query("s61_moved_breaks", f"{_AT} SELECT e.tree_id, e.child AS node, CASE WHEN w.node IS NULL THEN e.child WHEN e.parent = 'R' THEN coalesce(l.low, 'R') ELSE e.parent END AS moved FROM e LEFT JOIN way w ON w.tree_id = e.tree_id AND w.node = e.child LEFT JOIN lone l ON l.tree_id = e.tree_id WHERE e.child NOT LIKE 't:%'")
def _(spark, d):
    """The edge above every inner node is a break."""
    e, at = new_roots(spark, d)
    return ro.moved_breaks(e, spans(e), at, e.where("child NOT LIKE 't:%'").select("tree_id", F.col("child").alias("node")))
