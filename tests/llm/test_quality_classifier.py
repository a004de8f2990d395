import zlib

import numpy as np

from phylomill.llm import quality_classifier as qc

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = qc.op7_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]).all()
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    out = rows[rows.held_out]
    good, bad = out[out.quality == 1].predicted.mean(), 1 - out[out.quality == 0].predicted.mean()
    assert len(out) > 500 and good > 0.97 and bad > 0.9, (good, bad)


def test_densities_equal_the_formula():
    r = np.random.default_rng(1)
    n, mean = np.array([40.0, 60.0]), r.normal(size=(2, qc.P))
    cov = np.stack([a @ a.T + np.eye(qc.P) for a in r.normal(size=(2, qc.P, qc.P))])
    m, x = qc.Discriminant(n, mean, cov), r.normal(size=(9, qc.P))
    share = n / n.sum()
    pooled = share[0] * cov[0] + share[1] * cov[1]
    s = np.diag(m.scale)
    log = []
    for c in (0, 1):
        full = (1 - qc.POOL - qc.RIDGE) * cov[c] + qc.POOL * pooled + qc.RIDGE * s @ s
        d = x - mean[c]
        log.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(full)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(full), d))
    assert np.allclose(m.score(x), 1 / (1 + np.exp((log[0] - log[1]) / qc.TEMPERATURE)))


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (3, "x " * 5000, "e"), (4, "a b\n\na b", "e"), (4, "a b\n\na b", "e"), (None, "z", "e")], "doc_id long, text string, quality string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = qc.classify(df, none).collect()
    assert len(got) == 6 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    one = spark.createDataFrame([(3, 1, 0), (3, None, 0), (9, 0, 1), (1, 7, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in qc.classify(df, one).collect())
    assert qc.classify(df.where("doc_id < 0"), none).count() == 0
