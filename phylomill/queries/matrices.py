"""Sources, encoding, filters, duplicates and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from phylomill import fixtures as fx
from phylomill.functions import nucleotides as nt
from phylomill.operators import characters as ch
from phylomill.operators import duplicates as du
from phylomill.operators import resample as rs
from phylomill.registry import query
from phylomill.sources import fasta, matrix
from phylomill.sources import trees as ts

C, BITS = fx.CHARACTERS, fx.BITS
LETTER = "CASE WHEN code BETWEEN 1 AND 15 THEN substring('ATWCMYHGRKDSVBN', code, 1) ELSE '-' END"


@query("s01_fasta_records", "SELECT concat('d', doc_id) AS name, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS INT) AS length FROM {documents} WHERE regexp_replace(text, '\\s+', '', 'g') <> ''")
def _(spark, d):
    raw = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit(">d"), "doc_id", F.lit(" "), "lang", F.lit("\n"), "text").alias("value"))
    return fasta.records(raw, same_length=False).select("name", F.length("seq").alias("length"))


@query("s02_fasta_pick", """
WITH w AS (SELECT DISTINCT user_id AS record FROM {events} WHERE user_id > 0), r AS (SELECT doc_id AS record FROM {documents})
SELECT record, true AS found FROM r WHERE record IN (SELECT record FROM w) UNION ALL SELECT record, false FROM w WHERE record NOT IN (SELECT record FROM r)""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("record"), "text")
    hit, missing = fasta.picked(rows, spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("record")))
    return hit.select("record", F.lit(True).alias("found")).unionByName(missing.select("record", F.lit(False).alias("found")))


@query("s03_fasta_texts", f"SELECT CAST(tip_id AS STRING) AS name, string_agg({LETTER}, '' ORDER BY site) AS seq FROM ({fx.DNA_DUCKDB}) x GROUP BY tip_id")
def _(spark, d):
    return fasta.texts(fx.table(spark, d, fx.DNA))


@query("s04_digit_matrix", """
SELECT tip, CAST(p - 1 AS INT) AS site, CAST(substring(s, p, 1) AS INT) AS state
FROM (SELECT o_orderkey AS tip, s, unnest(range(1, length(s) + 1)) AS p FROM (SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s FROM {orders}) a) b""")
def _(spark, d):
    return matrix.from_digits(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("tip"), F.col("o_orderkey").cast("string").alias("digits")))


@query("s05_newick_edges", f"SELECT tree_id, parent, child, CAST(1 + length(child) % 3 AS DOUBLE) AS length FROM ({fx.TREES}) t WHERE child LIKE 't:%'")
def _(spark, d):
    """Every (nation, segment) clade of every tree goes through its Newick text."""
    e = fx.table(spark, d, fx.TREE_EDGES).where("child LIKE 't:%'")
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    text = F.concat(F.lit("("), F.array_join(F.collect_list(F.concat(quoted("child"), F.lit(":"), F.col("length").cast("string"))), ","), F.lit(")"), quoted(F.first("parent")), F.lit(";"))
    lines = e.groupBy("tree_id", "parent").agg(text.alias("newick"))
    return ts.edges(lines.select("tree_id", "newick")).select("tree_id", "parent", "child", "length")


@query("s06_jplace_placements", f"SELECT CAST(cluster_id AS STRING) AS file, CAST(query AS STRING) AS query, edge_child AS edge_num, shared / 8.0E0 AS like_weight_ratio FROM ({fx.VOTES}) v")
def _(spark, d):
    v = fx.table(spark, d, fx.VOTES)
    one = F.struct(F.array(F.array(F.lit(-1.0), F.col("edge_child").cast("double"), F.col("shared") / 8.0)).alias("p"), F.array(F.col("query").cast("string")).alias("n"))
    # a file for each thousand queries of a cluster
    json = v.groupBy("cluster_id", (F.col("query") / 1000).cast("int").alias("k")).agg(F.collect_list(one).alias("placements"))
    json = json.select(F.col("cluster_id").cast("string").alias("file"), F.to_json(F.struct(F.lit("();").alias("tree"), F.array(F.lit("likelihood"), F.lit("edge_num"), F.lit("like_weight_ratio")).alias("fields"), "placements")).alias("json"))
    return ts.placements(json)


@query("s07_valid_bases", "SELECT CAST(doc_id AS STRING) AS name, CAST(length(regexp_replace(text, '[-.Nn]', '', 'g')) AS INT) AS valid FROM {documents}")
def _(spark, d):
    return fasta.valid_base_report(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("seq")))


@query("s08_regularized", f"""
WITH c AS ({C}), n AS (SELECT site, state, dense_rank() OVER (PARTITION BY site ORDER BY state) AS k FROM (SELECT DISTINCT site, state FROM c WHERE state > 1) x)
SELECT c.tip_id, c.site, CAST(CASE WHEN c.state <= 0 THEN c.state ELSE n.k END AS INT) AS state FROM c LEFT JOIN n ON c.site = n.site AND c.state = n.state WHERE c.state <= 0 OR n.k IS NOT NULL""")
def _(spark, d):
    c = fx.table(spark, d, C)
    return ch.regularize(c, c.where("state > 1"))


@query("s09_mutation_dictionary", f"SELECT site, state, row_number() OVER (ORDER BY site, state) - 1 AS mut_id FROM (SELECT DISTINCT site, state FROM ({C}) c) x")
def _(spark, d):
    return ch.mutation_dictionary(fx.table(spark, d, C), code_unmutated=True)


@query("s09_packed_words", f"""
WITH c AS ({C}), n AS (SELECT site, state, row_number() OVER (ORDER BY site, state) - 1 AS m FROM (SELECT DISTINCT site, state FROM c WHERE state > 0) x)
SELECT tip_id, CAST(m // 32 AS INT) AS word, CAST(sum(CAST(1 AS BIGINT) << CAST(m % 32 AS INT)) AS BIGINT) AS bits FROM c JOIN n ON c.site = n.site AND c.state = n.state GROUP BY tip_id, m // 32""")
def _(spark, d):
    c = fx.table(spark, d, C)
    return ch.packed(ch.coded(c, ch.mutation_dictionary(c)))


@query("s10_informative_sites", f"WITH b AS (SELECT tip_id, site FROM ({fx.BITS_DUCKDB}) x) SELECT tip_id, site FROM b WHERE site IN (SELECT site FROM b GROUP BY site HAVING count(*) >= 250)")
def _(spark, d):
    return ch.informative(fx.table(spark, d, BITS).select("tip_id", "site"), 250)


@query("s13_iupac_codes", f"WITH x AS ({fx.DNA_DUCKDB}) SELECT tip_id, string_agg({LETTER}, '' ORDER BY site) AS letters, CAST(sum(code * (site % 97)) AS BIGINT) AS codes FROM x GROUP BY tip_id")
def _(spark, d):
    """Every character there and back; a row for each sequence."""
    x = fasta.runs(fx.table(spark, d, fx.DNA))
    again = F.transform(nt.encoded_text(F.col("letters")), lambda code, i: code * ((F.col("first") + i) % 97))
    codes = F.sum(F.aggregate(again, F.lit(0).cast("long"), lambda total, c: total + c))
    return fasta.joined(x, codes=codes).select("tip_id", F.col("seq").alias("letters"), "codes")


@query("s14_base_counts", "SELECT doc_id, " + ", ".join(f"CAST(length(text) - length(regexp_replace(text, '[{b.upper()}{b}]', '', 'g')) AS INT) AS n_{b}" for b in "atcg") + " FROM {documents}")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", *[nt.base_count(F.col("text"), b).alias(f"n_{b}") for b in "atcg"])


@query("s15_variable_sites", f"""
WITH x AS ({fx.DNA_DUCKDB}), k AS (SELECT site FROM x GROUP BY site HAVING {" OR ".join(f"(sum(CASE WHEN code & {b} <> 0 THEN 1 ELSE 0 END) BETWEEN 1 AND count(*) - 1)" for b in (1, 2, 4, 8))})
SELECT site, count(*) AS n, CAST(sum(code * (tip_id % 89)) AS BIGINT) AS codes FROM x WHERE site IN (SELECT site FROM k) GROUP BY site""")
def _(spark, d):
    """The alignment left, summed up by site."""
    return ch.variable_sites(fx.table(spark, d, fx.DNA)).groupBy("site").agg(F.count("*").alias("n"), F.sum(F.col("code") * (F.col("tip_id") % 89)).cast("long").alias("codes"))


@query("s16_subset", f"WITH c AS ({C}), b AS (SELECT c_custkey AS tip_id FROM {{customer}} WHERE c_mktsegment = 'BUILDING') SELECT tip_id, site, state, tip_id IN (SELECT tip_id FROM b) AS inside FROM c")
def _(spark, d):
    c = fx.table(spark, d, C)
    b = spark.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("tip_id"))
    return ch.subset(c, b).withColumn("inside", F.lit(True)).unionByName(ch.subset(c, b, False).withColumn("inside", F.lit(False)))


def _sets(group: int) -> str:
    return f"SELECT tip_id, list(site ORDER BY site) AS s FROM ({fx.GROUPS_DUCKDB[group]}) x GROUP BY tip_id"


@query("s17_exact_duplicates", f"SELECT tip_id, min(tip_id) OVER (PARTITION BY s) AS rep_tip_id FROM ({_sets(11)}) y")
def _(spark, d):
    return du.exact(fx.table(spark, d, fx.GROUPS[11]))


@query("s18_containment", f"""
WITH RECURSIVE c AS ({C}), n AS (SELECT tip_id, count(*) AS k FROM c GROUP BY tip_id),
p AS (SELECT a.tip_id AS i, b.tip_id AS j FROM c a JOIN n u ON u.tip_id = a.tip_id JOIN c b ON a.site = b.site AND a.state = b.state AND a.tip_id <> b.tip_id GROUP BY 1, 2, u.k HAVING count(*) = u.k),
f AS (SELECT i, min(j) AS j FROM p GROUP BY i),
g AS (SELECT f.i, f.j FROM f JOIN n x ON x.tip_id = f.i JOIN n y ON y.tip_id = f.j WHERE f.j < f.i OR y.k > x.k),
w AS (SELECT tip_id, tip_id AS here FROM n UNION ALL SELECT w.tip_id, g.j FROM w JOIN g ON g.i = w.here)
SELECT tip_id, here AS rep_tip_id FROM w WHERE here NOT IN (SELECT i FROM g)""")
def _(spark, d):
    return du.containing(fx.table(spark, d, C))


@query("s19_composed_duplicates", f"""
WITH a AS (SELECT tip_id, min(tip_id) OVER (PARTITION BY s) AS rep FROM ({_sets(11)}) y),
b AS (SELECT tip_id, min(tip_id) OVER (PARTITION BY s) AS rep FROM ({_sets(22)}) y WHERE tip_id IN (SELECT rep FROM a))
SELECT a.tip_id, coalesce(b.rep, a.rep) AS rep_tip_id FROM a LEFT JOIN b ON b.tip_id = a.rep""")
def _(spark, d):
    first = du.exact(fx.table(spark, d, fx.GROUPS[11]))
    reps = first.select(F.col("rep_tip_id").alias("tip_id")).distinct()
    return du.composed(first, du.exact(fx.table(spark, d, fx.GROUPS[22]).join(reps, "tip_id", "left_semi")))


_REP = "SELECT concat('t:', CAST(c_custkey AS STRING)) AS tip, concat('t:', CAST(min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 3) AS STRING)) AS rep FROM {customer}"


@query("s20_reinserted", f"""
WITH r AS ({_REP}), e AS (SELECT parent, child, CAST(1 + length(child) % 3 AS DOUBLE) AS length FROM ({fx.TREE_A}) t WHERE child NOT LIKE 't:%' OR child IN (SELECT rep FROM r)), x AS (SELECT DISTINCT rep FROM r WHERE tip <> rep)
SELECT parent, CASE WHEN child IN (SELECT rep FROM x) THEN concat('d:', child) ELSE child END AS child, length FROM e
UNION ALL SELECT concat('d:', rep), rep, 0.0E0 FROM x UNION ALL SELECT concat('d:', rep), tip, 0.0E0 FROM r WHERE tip <> rep""")
def _(spark, d):
    r = fx.table(spark, d, _REP)
    e = fx.table(spark, d, fx.TREE_EDGES).where("tree_id = 'A'")
    keep = r.select(F.col("rep").alias("child")).distinct()
    e = e.where("child NOT LIKE 't:%'").unionByName(e.where("child LIKE 't:%'").join(keep, "child", "left_semi").select(e.columns))
    return du.reinserted(e, r)


def _scrambled(*keys: str) -> str:
    x = "CAST(1 AS BIGINT)"
    for k in keys:
        x = f"((({x} + CAST({k} AS BIGINT)) * 48271 + 11) % 2147483647 * 69621 + 7) % 2147483647"
    return x


_DRAWS = f"""
s AS (SELECT DISTINCT site FROM ({C}) c), g AS (SELECT CAST(r.range AS INT) AS rep, site FROM s CROSS JOIN range(1, 6) r),
k AS (SELECT rep, CAST(({_scrambled("rep", "site")}) % (SELECT count(*) FROM s) AS INT) AS site FROM g),
w AS (SELECT g.rep, g.site, count(k.site) AS weight FROM g LEFT JOIN k ON k.rep = g.rep AND k.site = g.site GROUP BY 1, 2)"""


@query("s78_bootstrap_weights", f"WITH {_DRAWS} SELECT rep, site, weight FROM w")
def _(spark, d):
    return rs.site_weights(fx.table(spark, d, C).select("site").distinct(), 5)


@query("s79_bootstrap_alignment", f"""
WITH {_DRAWS}, p AS (SELECT rep, site, CAST(row_number() OVER (PARTITION BY rep ORDER BY site) - 1 AS INT) AS new_site FROM (SELECT rep, site, unnest(range(weight)) FROM w) u)
SELECT p.rep, c.tip_id, p.new_site, c.site, c.state FROM ({C}) c JOIN p ON p.site = c.site""")
def _(spark, d):
    c = fx.table(spark, d, C)
    return rs.alignment(c, rs.site_weights(c.select("site").distinct(), 5))


@query("s80_random_weights", f"""
SELECT CAST(r.range AS INT) AS rep, site, state, 0.5E0 + (({_scrambled("r.range", "site", "state")}) % 1024) / 1024.0E0 AS weight
FROM (SELECT DISTINCT site, state FROM ({C}) c WHERE state > 0) m CROSS JOIN range(1, 6) r""")
def _(spark, d):
    return rs.random_weights(fx.table(spark, d, C).where("state > 0"), 5)


@query("s80_noise_weights", f"""
SELECT CAST(r.range AS INT) AS rep, site, state, 1.0E0 + ((({_scrambled("r.range", "site", "state")}) % 1024) / 512.0E0 - 1.0E0) * 0.25E0 AS weight
FROM (SELECT DISTINCT site, state FROM ({C}) c WHERE state > 0) m CROSS JOIN range(1, 6) r""")
def _(spark, d):
    return rs.noise_weights(fx.table(spark, d, C).where("state > 0"), 5, 0.25)
