"""Operator 10: quality rules with a robust multivariate outlier test, in DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated three-word windows of the whole text. Documents that
pass them are held against the minimum-covariance-determinant (MCD) estimate of their language and source. Three
deterministic starts (median deviations, correlations of tanh-scaled deviations, mean and covariance of all) each go
through concentration steps: keep the ``SUPPORT`` share of documents with the least Mahalanobis distance, estimate
again, until the determinant stops falling. The start that ends with the least determinant gives the raw estimate; a
reweighted one gives the final distances. Documents beyond ``CUTOFF`` (a chi-square quantile) are rejected.

The estimates are made of counts of cells: all documents of a group whose transformed statistics agree to 1/``GRID``
are one row, so that the steps don't grow with the corpus once its cells are filled, and a group that holds a third of
all rows is combined before it is shuffled. Sums over cells are sums of whole numbers and don't depend on the order of
rows. A group of fewer than ``MIN_GROUP`` documents, five for each statistic, has no covariance worth the name; it
borrows the estimate of its language, and a small language that of the whole table. Distances are those of the exact
statistics.

Defined cases: a null or empty text has no words and fails the base rules; a null language or source is a group of
its own; a null doc_id is judged like any other; repeated rows are judged each, and alike; other columns are ignored;
statistics that hardly vary get at least the variance ``FLOOR``, so ties are no outliers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomill.stash import discard, stash

BLANK = " \t\n\x0b\f\r"
SUPPORT = 0.75
CUTOFF = 23.51  # chi-square, 4 degrees of freedom, 0.9999
REWEIGHT = 11.143  # 0.975
# consistency factors of a covariance made of the least distances: share / P(chi-square of 6 <= quantile of 4)
RAW, REWEIGHTED = 1.4864, 1.0645
FLOOR = (0.05**2, 0.25**2, 0.4**2, 0.35**2)
X = ("x1", "x2", "x3", "x4")
P = len(X)
MIN_GROUP = 5 * P
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
GRID = 512
BINS = 256  # of a distance, for each factor of e
LESS = 1e-9  # a determinant has fallen if it is less by this share
MOST_GROUPS = 100_000  # estimates are sent to all executors up to here (75 MB), and joined by key beyond


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` at the sorted ``starts``."""
    gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), a row for each row; ``whole``: with it."""
    own = [F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns]).alias("row")] if whole else []
    t = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("trimmed", F.btrim("t", F.lit(BLANK)))
    t = t.withColumn("w", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+", -1)))
    t = t.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    n = F.size("w")
    t = t.select(
        "doc_id", *(["row"] if whole else []), "lang", "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    t = t.withColumn("sorted", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h")))
    t = t.withColumn("twice", F.array_distinct(F.array_compact(F.zip_with("sorted", F.slice("sorted", F.lit(2), F.greatest(F.size("sorted"), F.lit(1))), lambda a, b: F.when(a == b, a)))))
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda i: i.isNotNull())
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    t = t.withColumn("placed", F.when(F.size("twice") > 32, placed))
    again = F.zip_with("placed", F.slice("placed", F.lit(2), F.greatest(F.size("placed"), F.lit(1))), lambda a, b: F.when(a.x == b.x, F.array(a.i, b.i)))
    many = F.array_sort(F.array_distinct(F.flatten(F.array_compact(again))))
    t = t.withColumn("starts", F.when(F.size("twice") > 32, many).when(F.size("twice") > 0, few))
    return t.withColumn("n_repeat_words", F.coalesce(F.when(F.size("starts") > 0, _covered(F.col("starts"), 3)), F.lit(0)).cast("long")).drop("h", "sorted", "twice", "placed", "starts")


def vectors(stats: DataFrame) -> DataFrame:
    """Base verdict and the transformed statistics x1..x4 of each document."""
    n, c = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).withColumns({
        "x1": F.log(c / F.greatest(n, F.lit(1))),
        "x2": F.log1p(100.0 * F.col("n_symbols") / c),
        "x3": F.log1p(100.0 * F.col("n_dup_lines") / F.greatest(n, F.lit(1))),
        "x4": F.log1p(20.0 * F.col("n_repeat_words") / F.greatest(n, F.lit(1))),
    })


def _joined(rows: DataFrame, estimates: DataFrame, small: bool, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(estimates) if small else estimates, keys)


def _floored(v: Column, i: int, j: int) -> Column:
    return F.greatest(v, F.lit(FLOOR[i])) if i == j else v


def _factored(m: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the Cholesky factor l11, l21.. of the covariance and its determinant; floors keep every pivot positive."""
    for i, j in sorted(PAIRS, key=lambda p: (p[1], p[0])):
        rest = reduce(lambda s, k: s - F.col(f"l{i + 1}{k + 1}") * F.col(f"l{j + 1}{k + 1}"), range(j), F.col(f"v{i + 1}{j + 1}"))
        m = m.withColumn(f"l{i + 1}{j + 1}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] / 1e3))) if i == j else rest / F.col(f"l{j + 1}{j + 1}"))
    det = reduce(lambda a, b: a * b, [F.col(f"l{i + 1}{i + 1}") for i in range(P)])
    return m.select(*keys, *[f"m{i + 1}" for i in range(P)], *[f"l{i + 1}{j + 1}" for i, j in PAIRS], det.alias("det"))


def distances(rows: DataFrame, estimates: DataFrame, small: bool, keys: list[str]) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the estimate of each row's ``keys``."""
    out = _joined(rows, estimates, small, keys)
    y: list[Column] = []
    for i in range(P):
        y.append(reduce(lambda s, k: s - F.col(f"l{i + 1}{k + 1}") * y[k], range(i), F.col(X[i]) - F.col(f"m{i + 1}")) / F.col(f"l{i + 1}{i + 1}"))
    return out.withColumn("d2", reduce(lambda a, b: a + b, [v * v for v in y]))


def _moments(cells: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys.., m1.., v11, v21..): mean and floored covariance of the cells, ``factor`` times what they have."""
    n = F.col("n")
    sums = [F.sum("n").alias("n"), *[F.sum(n * F.col(f"b{i + 1}")).alias(f"s{i + 1}") for i in range(P)], *[F.sum(n * F.col(f"b{i + 1}") * F.col(f"b{j + 1}")).alias(f"s{i + 1}{j + 1}") for i, j in PAIRS]]
    m = cells.groupBy(*keys).agg(*sums)
    mean = [(F.col(f"s{i + 1}") / n / GRID).alias(f"m{i + 1}") for i in range(P)]
    cov = lambda i, j: (F.col(f"s{i + 1}{j + 1}") / n - F.col(f"s{i + 1}") / n * (F.col(f"s{j + 1}") / n)) / (GRID * GRID) * factor
    return m.select(*keys, *mean, *[_floored(cov(i, j), i, j).alias(f"v{i + 1}{j + 1}") for i, j in PAIRS])


def _log_bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-9) * BINS)


def grouped(rows: DataFrame) -> DataFrame:
    """Adds g, the group whose estimate a row is held against."""
    counts = rows.groupBy("lang", "source").agg(F.sum(F.when(~F.col("base_failed"), 1).otherwise(0)).alias("c"))
    by_lang = counts.groupBy("lang").agg(F.sum("c").alias("cl"))
    g = F.when(F.col("c") >= MIN_GROUP, F.concat_ws("\x01", "lang", "source")).when(F.col("cl") >= MIN_GROUP, F.concat(F.col("lang"), F.lit("\x01\x02"))).otherwise(F.lit("\x02"))
    names = stash(counts.join(by_lang, "lang").select("lang", "source", g.alias("g")), "groups")
    return rows.join(F.broadcast(names) if names.count() <= MOST_GROUPS else names, ["lang", "source"])


def cells_of(rows: DataFrame, small: bool, wanted: DataFrame) -> DataFrame:
    """(g, n, b1.., x1..): how many documents of each group have the same rounded statistics.

    The estimates of a language and of the table, which small groups borrow, are made of all of its documents.
    """
    bins = [F.round(F.col(x) * GRID).cast("long").alias(f"b{i + 1}") for i, x in enumerate(X)]
    b = [f"b{i + 1}" for i in range(P)]
    own = rows.select("lang", F.concat_ws("\x01", "lang", "source").alias("own"), *bins).groupBy("lang", "own", *b).agg(F.count("*").alias("n"))
    gs = F.array("own", F.concat(F.col("lang"), F.lit("\x01\x02")), F.lit("\x02"))
    wide = _joined(own.select(F.explode(gs).alias("g"), "n", *b), wanted, small, ["g"])
    return wide.groupBy("g", *b).agg(F.sum("n").alias("n")).select("g", "n", *b, *[(F.col(f"b{i + 1}") / GRID).alias(x) for i, x in enumerate(X)])


def starts(cells: DataFrame, small: bool) -> DataFrame:
    """(g, s, m1.., l11.., det): the first estimates."""
    mid = stash(cells.groupBy("g").agg(*[F.percentile(f"b{i + 1}", F.lit(0.5), F.col("n")).alias(f"c{i + 1}") for i in range(P)]), "medians")
    off = _joined(cells, mid, small, ["g"])
    off = off.select("g", "n", *[(F.col(f"b{i + 1}") - F.col(f"c{i + 1}")).alias(f"o{i + 1}") for i in range(P)])
    mad = off.groupBy("g").agg(*[F.percentile(F.abs(F.col(f"o{i + 1}")), F.lit(0.5), F.col("n")).alias(f"a{i + 1}") for i in range(P)])
    scale = [F.greatest(1.4826 * F.col(f"a{i + 1}") / GRID, F.lit(FLOOR[i] ** 0.5)).alias(f"a{i + 1}") for i in range(P)]
    base = stash(mid.join(mad, "g").select("g", *[(F.col(f"c{i + 1}") / GRID).alias(f"m{i + 1}") for i in range(P)], *scale), "scales")
    plain = base.select("g", F.lit(0).alias("s"), *[f"m{i + 1}" for i in range(P)], *[(F.col(f"a{i + 1}") ** 2 if i == j else F.lit(0.0)).alias(f"v{i + 1}{j + 1}") for i, j in PAIRS])
    # whole numbers again, so that sums don't depend on the order of rows
    t = _joined(cells, base, small, ["g"]).select("g", "n", *[F.round(F.tanh((F.col(x) - F.col(f"m{i + 1}")) / F.col(f"a{i + 1}")) * 1024).alias(f"t{i + 1}") for i, x in enumerate(X)])
    n = F.col("n")
    t = t.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(n * F.col(f"t{i + 1}")).alias(f"t{i + 1}") for i in range(P)], *[F.sum(n * F.col(f"t{i + 1}") * F.col(f"t{j + 1}")).alias(f"t{i + 1}{j + 1}") for i, j in PAIRS])
    cov = lambda i, j: F.col(f"t{i + 1}{j + 1}") / n - F.col(f"t{i + 1}") / n * (F.col(f"t{j + 1}") / n)
    spread = lambda i: F.sqrt(F.greatest(cov(i, i), F.lit(1.0)))
    t = t.select("g", *[(cov(i, j) / spread(i) / spread(j)).alias(f"r{i + 1}{j + 1}") for i, j in PAIRS if i != j])
    bent = base.join(t, "g").select("g", F.lit(1).alias("s"), *[f"m{i + 1}" for i in range(P)], *[(F.col(f"a{i + 1}") ** 2 if i == j else F.col(f"a{i + 1}") * F.col(f"a{j + 1}") * F.col(f"r{i + 1}{j + 1}")).alias(f"v{i + 1}{j + 1}") for i, j in PAIRS])
    every = _moments(cells, ["g"], 1.0).withColumn("s", F.lit(2)).select(plain.columns)
    return _factored(plain.unionByName(bent).unionByName(every), ["g", "s"])


def concentrated(cells: DataFrame, estimates: DataFrame, small: bool, first: bool) -> DataFrame:
    """One concentration step for the starts that are not at their end: (g, s, m1.., l11.., det, done).

    A step that doesn't lower the determinant changes nothing, and ends its start.
    """
    scored = distances(cells, estimates.where("NOT done"), small, ["g"]).withColumn("bin", _log_bin(F.col("d2")))
    cut = stash(scored.groupBy("g", "s").agg(F.percentile("bin", F.lit(SUPPORT), F.col("n")).alias("cut")), "cut")
    near = _joined(scored, cut, small, ["g", "s"]).where("bin <= cut")
    new = _factored(_moments(near, ["g", "s"], 1.0), ["g", "s"])
    old = estimates.select("g", "s", *[F.col(c).alias(f"old_{c}") for c in estimates.columns if c not in ("g", "s")])
    both = old.join(new, ["g", "s"], "left")
    # the first estimate is no minimum over a share of the documents, so the first step is always taken
    better = F.lit(True) if first else F.coalesce(F.col("det") < F.col("old_det") * (1 - LESS), F.lit(False))
    out = stash(both.select("g", "s", *[F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in estimates.columns if c not in ("g", "s", "done")], (~better).alias("done")), "mcd")
    discard(cut)
    return out


def mcd(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(g, m1.., l11..) from all rows with g, lang, source and x1..x4; whether they are few enough to be broadcast."""
    wanted = stash(rows.select("g").distinct(), "wanted")
    small = wanted.count() <= MOST_GROUPS
    cells = stash(cells_of(rows, small, wanted), "cells")
    estimates = stash(starts(cells, small).withColumn("done", F.lit(False)), "mcd")
    first = True
    while not estimates.where("NOT done").isEmpty():
        new = concentrated(cells, estimates, small, first)
        discard(estimates)
        estimates, first = new, False
    least = estimates.groupBy("g").agg(F.min_by("s", F.struct("det", "s")).alias("s"))
    raw = stash(estimates.join(least, ["g", "s"]).select("g", *[f"m{i + 1}" for i in range(P)], *[f"l{i + 1}{j + 1}" for i, j in PAIRS]), "mcd")
    wide = raw.select("g", *[f"m{i + 1}" for i in range(P)], *[_floored(RAW * reduce(lambda a, b: a + b, [F.col(f"l{i + 1}{k + 1}") * F.col(f"l{j + 1}{k + 1}") for k in range(j + 1)]), i, j).alias(f"v{i + 1}{j + 1}") for i, j in PAIRS])
    near = distances(cells, _factored(wide, ["g"]), small, ["g"]).where(F.col("d2") <= REWEIGHT)
    return stash(_factored(_moments(near, ["g"], REWEIGHTED), ["g"]).drop("det"), "mcd"), small


def judge(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row for each row of ``docs``: base statistics, base_failed, d2 (null where the base rules fail), kept.

    ``whole``: with the row itself in the struct ``row``.
    """
    # written before it is grouped, so that texts are gone through once
    rows = grouped(stash(vectors(statistics(docs, whole)), "statistics"))
    passed = rows.where("NOT base_failed")
    estimates, small = mcd(passed)
    out = distances(passed, estimates, small, ["g"]).unionByName(rows.where("base_failed").withColumn("d2", F.lit(None).cast("double")), allowMissingColumns=True)
    kept = ~F.col("base_failed") & (F.col("d2") <= CUTOFF)
    own = ["row"] if whole else []
    return out.select("doc_id", *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "d2")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, their columns unchanged. Rows go with their statistics, so nothing is joined
    back to the texts, and null or repeated doc_ids play no part."""
    return judge(docs, whole=True).where("kept").select("row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("d2")
