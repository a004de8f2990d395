import random
import re
from collections import Counter

from phylomill.llm import quality_rules as qr


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    cover = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))


def corpus(seed, n=900):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 9)))
    docs = [(0, None, "en", "s"), (1, "", None, None), (2, " \t\n\x0b", "en", "s"), (3, "a b a b a b\na b\n a b\na b", "en", "s"), (4, "x " * 400, "en", "s")]
    long = [word() for _ in range(300)]
    docs.append((5, " ".join(long + long[:250]), "en", "s"))
    for i in range(6, n):
        words = [word() for _ in range(r.randint(40, 200))]
        if i % 40 == 0:
            words = [w + "$$%" for w in words]
        docs.append((i, r.choice([" ", "\n"]).join(words[:60]) + "\n" + " ".join(words[60:]), r.choice(["en", "de"]), r.choice(["s", "s", "t"])))
    return docs


def test_base_statistics(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, lang string, source string, g string")
    got = {r.doc_id: tuple(r)[1:] for r in qr.judge(df).drop("d2").collect()}
    assert len(got) == len(docs)
    for d, t, *_ in docs:
        assert got[d][:6] == brute(t), d
    junk = [d for d, *_ in docs if d > 5 and d % 40 == 0 and not got[d][5]]
    clean = [d for d, *_ in docs if d > 5 and d % 40 and not got[d][5]]
    assert junk and not any(got[d][6] for d in junk)
    assert sum(got[d][6] for d in clean) >= 0.99 * len(clean)
    assert not any(v[6] for v in got.values() if v[5])


def test_empty_table_and_ties(spark):
    df = spark.createDataFrame([(i, "w%d " % i * 3 + " ".join(f"x{j}" for j in range(60)), "en", "s") for i in range(120)], "doc_id long, text string, lang string, source string")
    assert all(r.kept for r in qr.judge(df).collect())
    assert qr.judge(df.where("doc_id < 0")).count() == 0


def plain_mcd(x, floor, starts, seed):
    """Least determinant that concentration steps reach from random starts, in plain numpy."""
    import numpy as np

    r, h, best = np.random.default_rng(seed), int(np.floor((len(x) - 1) * qr.SUPPORT)) + 1, np.inf
    for _ in range(starts):
        own, last = r.choice(len(x), 12, replace=False), np.inf
        while True:
            c = np.cov(x[own].T, bias=True)
            c[np.diag_indices(4)] = np.maximum(np.diag(c), floor)
            det = np.linalg.det(c)
            if len(own) == h and not det < last * (1 - 1e-9):
                break
            last = det if len(own) == h else last
            z = x - x[own].mean(0)
            own = np.argsort((z @ np.linalg.inv(c) * z).sum(1), kind="stable")[:h]
        best = min(best, last)
    return best


def test_minimum_determinant_against_numpy(spark, monkeypatch):
    """Groups of language and source with a fifth of outliers: a determinant within 10 % of the least that 60 random starts reach."""
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    rows, groups = [], {}
    for g, n in (("en", 300), ("de", 90), ("fr", 40)):
        x = np.abs(r.normal([1.6, 0.9, 1.2, 1.0], [0.2, 0.5, 0.7, 0.6], (n, 4)) @ (np.eye(4) + 0.3 * np.tri(4, k=-1)))
        x[: n // 5] += [3.0, 4.0, 4.0, 3.0]
        groups[g] = np.round(x * qr.GRID) / qr.GRID
        rows += [(g, "s", f"{g}\x01s", *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "lang string, source string, g string, x1 double, x2 double, x3 double, x4 double")
    raw = []
    plain = qr.concentrated

    def watched(*a):
        out = plain(*a)
        raw.append([tuple(x) for x in out.select("g", "s", "det").collect()])
        return out

    monkeypatch.setattr(qr, "concentrated", watched)
    final, _ = qr.mcd(df)
    got = {x.g: x for x in final.collect()}
    assert len(got) == 3 and len(raw) > 1
    for g, x in groups.items():
        det = min(d for k, _, d in raw[-1] if k == f"{g}\x01s") ** 2
        assert det <= plain_mcd(x, np.array(qr.FLOOR), 60, 1) * 1.1
    scored = qr.distances(df, final, True, ["g"]).withColumn("far", F.col("d2") > qr.CUTOFF).groupBy("lang", "far").count().collect()
    n = {(s.lang, s.far): s["count"] for s in scored}
    assert n[("en", True)] >= 50 and n[("en", False)] >= 235


def test_null_ids_repeated_rows_and_own_columns(spark):
    docs = corpus(2, 300) + [(None, None, None, None), (None, corpus(2, 300)[41][1], "en", "s")]
    docs += [docs[40], docs[40]]
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, lang string, source string, k1 string, `a-b` int")
    got = qr.judge(df).collect()
    assert len(got) == len(docs) and len({tuple(r) for r in got if r.doc_id == docs[40][0]}) == 1
    kept = qr.passing(df)
    assert kept.columns == df.columns
    kept = kept.collect()
    want = sorted(str(r.doc_id) for r in got if r.kept)
    assert sorted(str(r.doc_id) for r in kept) == want and sum(r.doc_id is None for r in kept) == 1
