"""Character matrices, alignments and trees derived from the given tables, by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

CHARACTERS = """
SELECT CAST(o.o_custkey AS BIGINT) AS tip_id, CAST(l.l_partkey % 30 AS INT) AS site, CAST(MIN(l.l_suppkey % 5) AS INT) AS state
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, l.l_partkey % 30"""

MUTATIONS = f"SELECT tip_id, site * 100 + state AS mut_id FROM ({CHARACTERS}) c WHERE state > 0"

#: The same cells as set bits (state 2) and as bases, one state being ambiguous.
CHARACTER_BITS = f"SELECT tip_id, site, 2 AS state FROM ({CHARACTERS}) c WHERE state > 2"
CHARACTER_BASES = f"SELECT tip_id, site, CASE state WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 15 END AS state FROM ({CHARACTERS}) c"

WEIGHTS = f"""
SELECT r.rep, m.site, m.state, 0.5E0 + ((m.site * 7919 + m.state * 104729 + r.rep * 1299709) % 1024) / 1024.0E0 AS weight
FROM (SELECT DISTINCT site, state FROM ({CHARACTERS}) c WHERE state > 0) m
CROSS JOIN (SELECT CAST(n_nationkey + 1 AS INT) AS rep FROM {{nation}} WHERE n_nationkey < 5) r"""

BITS = "SELECT vec_id AS tip_id, label, CAST(p AS INT) AS site FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS p, v WHERE v > 0"
BITS_DUCKDB = """SELECT vec_id AS tip_id, label, CAST(u.p AS INT) AS site
FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM {embeddings}) u WHERE u.v > 0"""

#: Groups of 11 (or 22) components of an embedding that are positive for the greater part.
_GROUPS = "SELECT tip_id, CAST(FLOOR(site / {n}) AS INT) AS site FROM ({bits}) b GROUP BY tip_id, CAST(FLOOR(site / {n}) AS INT) HAVING count(*) * 2 > {n}"
GROUPS = {n: _GROUPS.format(n=n, bits=BITS) for n in (11, 22)}
GROUPS_DUCKDB = {n: _GROUPS.format(n=n, bits=BITS_DUCKDB) for n in (11, 22)}

#: Whole texts as sequences; a site is a character.
_DNA = """
SELECT tip_id, CAST(p AS INT) AS site,
       CASE WHEN ch = ' ' THEN 15 WHEN ch >= 'a' AND ch <= 'z' THEN CASE ASCII(ch) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END ELSE 16 END AS code
FROM ({rows}) q"""
DNA = _DNA.format(rows="SELECT doc_id AS tip_id, i + 1 AS p, ch FROM {documents} LATERAL VIEW posexplode(filter(split(lower(text), ''), c -> c <> '')) e AS i, ch")
DNA_DUCKDB = _DNA.format(rows="SELECT doc_id AS tip_id, unnest(range(1, len(cs) + 1)) AS p, unnest(cs) AS ch FROM (SELECT doc_id, regexp_extract_all(lower(text), '(?s).') AS cs FROM {documents}) d")

_MOVED = "CASE WHEN c_custkey % 20 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END"


def _tree(tree: str, levels: tuple[str, ...]) -> str:
    """Edges of one tree: levels from the root down, each with the expression of its label."""
    label = {
        "R": "'R'", "g": "CONCAT('g:', CAST(n_regionkey AS STRING))", "n": "CONCAT('n:', CAST(nk AS STRING))", "m": "CONCAT('m:', c_mktsegment)",
        "s": "CONCAT('s:', CAST(nk AS STRING), ':', c_mktsegment)", "t": "CONCAT('t:', CAST(c_custkey AS STRING))",
    }
    nk = _MOVED if tree == "D" else "c_nationkey"
    q = f"(SELECT c.c_custkey, c.c_mktsegment, c.nk, x.n_regionkey FROM (SELECT c_custkey, c_mktsegment, {nk} AS nk FROM {{customer}}) c JOIN {{nation}} x ON c.nk = x.n_nationkey)"
    return " UNION ALL ".join(f"SELECT DISTINCT '{tree}' AS tree_id, {label[a]} AS parent, {label[b]} AS child FROM {q} q{i}" for i, (a, b) in enumerate(zip(levels, levels[1:])))


TREES = " UNION ALL ".join(_tree(t, tuple(x)) for t, x in (("A", "Rgnst"), ("B", "Rnst"), ("C", "Rmst"), ("D", "Rgnst")))
TREE_A = _tree("A", tuple("Rgnst"))
TREE_EDGES = f"SELECT tree_id, parent, child, CAST(1 + length(child) % 3 AS DOUBLE) AS length FROM ({TREES}) t"

#: Characters of the tips of the trees.
TIP_STATES = f"SELECT CONCAT('t:', CAST(tip_id AS STRING)) AS tip, site, state FROM ({CHARACTERS}) c"

VOTES = """
SELECT event_id AS query, CAST(user_id % 12 AS INT) AS edge_child, CAST(FLOOR(value) AS INT) AS shared,
       CAST(1 + event_id % 3 AS INT) AS size, CAST(user_id % 4 AS INT) AS cluster_id
FROM {events}"""


def table(spark: SparkSession, sf_dir: str, sql: str, characters: DataFrame | None = None, **given: DataFrame) -> DataFrame:
    """``sql`` over the tables that it names in braces, or over those ``given``; ``characters``: CHARACTERS as written
    before, for a query that reads them several times."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql} | given
    if characters is not None:
        sql, used = sql.replace(f"({CHARACTERS})", "{characters}"), used | {"characters": characters}
    return spark.sql(sql, **used)


def duckdb(sql: str) -> str:
    """The same text for DuckDB, where the tables are views."""
    return sql.format(**{t: t for t in TABLES})
