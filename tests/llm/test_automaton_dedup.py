import hashlib
import random
import re

from phylomill.llm import automaton_dedup
from phylomill.llm.automaton_dedup import SuffixAutomaton


def brute(docs, length):
    first, parts = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        parts[d] = words
        for i in range(len(words) - length + 1):
            first.setdefault(tuple(words[i : i + length]), (d, i))
    out = []
    for d, _ in docs:
        words = parts[d]
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < (d, i):
                gone[i : i + length] = [True] * length
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((d, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: [r.choice("ab") + r.choice("cdé\xa0") for _ in range(n)]
    pool = [text(60) for _ in range(5)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "x " * 90), (4, "x " * 91)]
    for i in range(5, 60):
        words = [w for _ in range(r.randint(1, 5)) for w in (r.choice(pool)[r.randint(0, 40) :] if r.random() < 0.5 else text(9))]
        docs.append((i, r.choice([" ", "\n", "  "]).join(words)))
    return docs + [(70, docs[20][1]), (71, docs[20][1]), (72, docs[21][1]), (72, docs[21][1])]


def test_equals_brute_force(spark):
    for seed, length in ((1, 6), (2, 11), (3, 20), (4, 1), (5, 2)):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, seg string, n int").repartition(3)
        got = automaton_dedup.dedup(df, length).drop("kept").collect()
        assert sorted(map(tuple, got)) == brute(docs, length), length
    assert automaton_dedup.dedup(df.where("doc_id < 0")).count() == 0


def test_matching_statistics():
    r = random.Random(5)
    for _ in range(60):
        ref = [[r.randint(0, 2) for _ in range(r.randint(1, 25))] for _ in range(r.randint(1, 5))]
        text = [r.randint(0, 3) for _ in range(40)]
        shard = SuffixAutomaton()
        for x in ref:
            shard.add(x)
        parts = {tuple(x[i:j]) for x in ref for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max([0, *(n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in parts)]) for i in range(len(text))]
        assert shard.statistics(text) == want


def test_rows_without_id_are_left_alone(spark):
    docs = [(None, "a b " * 300), (None, "a b " * 300), (1, "a b " * 300)]
    got = {r.doc_id: r for r in automaton_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[None].n_removed == 0 and got[1].n_removed > 0


def test_large_classes_are_split(spark, monkeypatch):
    from phylomill.llm import repeats

    monkeypatch.setattr(automaton_dedup, "MOST", 1)
    for seed, length in ((1, 6), (3, 20), (4, 1)):
        for most in (1000, 0):
            monkeypatch.setattr(repeats, "MOST_CLASSES", most)
            docs = corpus(seed)
            got = automaton_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length).drop("kept").collect()
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
    monkeypatch.setattr(automaton_dedup, "MOST", 20)
    got = automaton_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 10).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(docs, 10) and seen == [max(seen)] and max(seen) <= 20


def test_very_long_text(spark):
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60_000))
    docs = [(1, long), (2, "before " + long[5000:9000] + " after"), (3, "z")]
    got = automaton_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(docs, 20)
