import random
import re

from phylomill.llm import near_dedup


def brute(docs, width, threshold=80):
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: [f"w{r.randint(0, 40)}" for _ in range(n)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "Éa b"), (6, "éa b")]
    for g in range(12):
        base = text(r.randint(5, 60))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
            docs.append((len(docs), " ".join(w) if r.random() < 0.8 else "\t".join(w).upper()))
    return docs + [(len(docs), docs[-1][1])] * 2


def test_equals_brute_force(spark):
    for seed, width in ((1, 2), (2, 5)):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, 0, "z") for d, t in docs], "doc_id long, text string, component long, node string").repartition(3)
        got = near_dedup.components(df, width).collect()
        assert sorted(map(tuple, got)) == brute(docs, width)
    assert near_dedup.components(df.where("doc_id < 0")).count() == 0
