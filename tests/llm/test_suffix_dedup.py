import hashlib
import random
from collections import Counter

from phylomill.llm import suffix_dedup


def brute(docs, length):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    pool = [text(30) for _ in range(6)]
    docs = [(0, None), (1, ""), (2, "a" * 300), (3, "ab" * 90), (4, "ab" * 91)]
    for i in range(5, 70):
        docs.append((i, " ".join(r.choice(pool)[r.randint(0, 40) :] if r.random() < 0.4 else text(12) for _ in range(r.randint(1, 6)))))
    return docs + [(70, docs[20][1]), (71, docs[20][1]), (72, docs[20][1][5:]), (72, docs[20][1][5:])]


def test_equals_brute_force(spark):
    for seed, length in ((1, 40), (2, 97), (3, 150), (4, 1)):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, cls string, n int").repartition(3)
        got = suffix_dedup.dedup(df, length).drop("kept").collect()
        assert sorted(map(tuple, got)) == brute(docs, length), length


def test_contract_length_and_empty_table(spark):
    docs = corpus(9) + [(100, "x" * 399), (101, "y" * 401), (102, "q" + "z" * 398 + "q"), (103, "q" + "z" * 398 + "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.dedup(df).drop("kept").collect())) == brute(docs, 400)
    assert suffix_dedup.dedup(df.where("doc_id < 0")).count() == 0


def test_rows_without_id_are_left_alone(spark):
    docs = [(None, "a b " * 300), (None, "a b " * 300), (1, "a b " * 300)]
    got = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[None].n_removed == 0 and got[1].n_removed > 0


def test_large_classes_are_split(spark, monkeypatch):
    from phylomill.llm import repeats

    monkeypatch.setattr(suffix_dedup, "MOST", 1)
    for seed, length in ((1, 40), (2, 97), (4, 1)):
        for most in (1000, 0):
            monkeypatch.setattr(repeats, "MOST_CLASSES", most)
            docs = corpus(seed)
            got = suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length).drop("kept").collect()
            assert sorted(map(tuple, got)) == brute(docs, length), (length, most)


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    """No class keeps more than MOST distinct segments, however many documents have a passage."""
    from phylomill.llm import repeats

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    docs = [(i, " ".join([*(word() for _ in range(15)), passage, *(word() for _ in range(15))])) for i in range(120)]
    seen = []
    plain = repeats.resolved

    def watched(*args, **kw):
        found, counted = plain(*args, **kw)
        seen.append(max(x["count"] for x in counted.where("multi").groupBy("cls").count().collect() or [{"count": 0}]))
        return found, counted

    monkeypatch.setattr(repeats, "resolved", watched)
    monkeypatch.setattr(suffix_dedup, "MOST", 20)
    got = suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 60).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(docs, 60) and seen == [max(seen)] and max(seen) <= 20


def test_very_long_text(spark):
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60_000))
    docs = [(1, long), (2, "before " + long[5000:9000] + " after"), (3, "z")]
    got = suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(docs, 400)
