import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
import test_near_dedup  # noqa: E402
import test_quality_rules  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if i < 4:
            assert docs.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes
        if name == "quality rules":
            bad = {d for d, r in before.items() if test_quality_rules.brute(r.text)[5]}
            assert bad and not bad & set(after) and len(after) > 0.9 * (len(before) - len(bad))
        elif name == "line dedup":
            assert any(after[d].text != before[d].text for d in after)
            seen: set[str] = set()
            for d in sorted(before):
                old = before[d].text.split("\n")
                if d not in after:  # a copy: every line is in some earlier document
                    assert set(filter(str.strip, old)) <= seen
                    continue
                new = after[d].text.split("\n")
                rest = iter(old)
                assert all(x in rest for x in new) or new == [""]
                gone = list(old)
                for x in new:
                    if x in gone:
                        gone.remove(x)
                assert set(filter(str.strip, gone)) <= seen
                seen |= set(old)
                assert after[d].n_chars == len(after[d].text)
        elif name == "near duplicates":
            want = {d for d, _, _, kept in test_near_dedup.brute([(d, r.text) for d, r in sorted(before.items())], 5) if kept}
            assert set(after) == want
        elif name == "benchmark decontamination":
            words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
            items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {d for d, r in before.items() if any(f" {x} " in f" {words(r.text)} " for x in items)}
        else:
            assert set(after) == set(before) and all(r.round_trip and r.text == before[d].text for d, r in after.items())


def test_run_equals_the_stages(spark):
    a = corpus_pipeline.run(spark, SF)
    assert a.count() > 50 and a.where("NOT round_trip").count() == 0 and a.columns[-2:] == ["pieces", "round_trip"]


def test_each_stage_with_hard_rows(spark):
    """Nulls in every column, repeated rows, a very long text, an empty table and columns with clashing names."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = " ".join(f"word{i}" for i in range(120))
    rows = [dict.fromkeys(schema.names), {"doc_id": 1, "text": None}, {"doc_id": 2, "text": ""}, {"doc_id": None, "text": text}, {"doc_id": 3, "text": text, "lang": "en"}, {"doc_id": 3, "text": text, "lang": "en"}, {"doc_id": 4, "text": "v" * 200_000}, {"doc_id": 5, "text": text + "\n" + "x y z " * 20_000}]
    names = [*schema.names, "gone_id", "id_", "gone_", "g", "pieces", "a-b", "n_deleted"]
    docs = spark.createDataFrame([tuple(r.get(c) for c in schema.names) + ("q",) * 7 for r in rows], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", gone_id string, id_ string, gone_ string, g string, pieces string, `a-b` string, n_deleted string")
    want = {"quality rules": [None, 3, 3], "line dedup": [None, None, 1, 2, 3, 3, 4, 5], "near duplicates": [None, None, 1, 2, 3, 3, 4], "benchmark decontamination": [None, None, 1, 2, 3, 3, 4, 5], "sentencepiece": [None, None, 1, 2, 3, 3, 4, 5]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert set(out.columns) == (set(names) if name != "sentencepiece" else {*names, "round_trip"}), name
        assert sorted((r.doc_id for r in got), key=str) == sorted(want[name], key=str), name
        assert stage(spark, docs.limit(0), SF).count() == 0
