import random

from phylomill.llm import line_dedup


def run(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, gone_ string, `at b-c` int").repartition(3)
    out = line_dedup.dedup(df, **kw)
    assert out.columns == ["doc_id", "text", "gone_", "at b-c", "n_deleted"]
    return sorted((r.doc_id, r.text, r.n_deleted) for r in out.collect())


def test_blocks_go_from_the_later_document(spark):
    block = "one two three\nfour five six\nseven eight"
    docs = [
        (1, "head a\n" + block + "\ntail a"),
        (2, "head b\n\n" + block + "\n \ntail b"),
        (3, block),
        (4, "seven eight\nfour five six\none two three"),  # other order: no block of 8 words
        (5, None),
        (6, ""),
        (7, "\n \n"),
        (8, "one two three"),
        (9, "same line here\nsame line here\nsame line here"),
        (10, "same line here\nsame line here\nsame line here\nsame line here"),
    ]
    got = {d: (t, n) for d, t, n in run(spark, docs, min_words=8)}
    assert got[1] == (docs[0][1], 0)
    assert got[2] == ("head b\n\n \ntail b", 3)
    assert got[3] == ("", 3)
    assert got[4] == (docs[3][1], 0) and got[8] == (docs[7][1], 0)
    assert got[5] == (None, 0) and got[6] == ("", 0) and got[7] == ("\n \n", 0)
    assert got[10] == ("same line here", 3)
    assert run(spark, [(1, "x y")], min_words=1) == [(1, "x y", 0)]


def test_a_line_that_every_document_has(spark):
    docs = [(i, f"shared licence line\nown {i} a\nown {i} b") for i in range(40)]
    assert run(spark, docs, min_words=4) == docs_kept(docs)
    assert [n for _, _, n in run(spark, docs, min_words=3)] == [0] + [1] * 39


def docs_kept(docs):
    return [(d, t, 0) for d, t in docs]


def longest(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        best[i] = 1 + max([0, *(best[j] for j in range(i) if pairs[j][1] < pairs[i][1])])
    return max([0, *best])


def test_patience_is_a_longest_increasing_run():
    r = random.Random(3)
    for _ in range(200):
        b = r.sample(range(30), r.randint(0, 12))
        pairs = sorted((i * 2, x, True) for i, x in enumerate(b))
        out = line_dedup.patience(pairs)
        assert len(out) == longest(pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(out, out[1:]))
        mixed = [(a, x, r.random() < 0.6) for a, x, _ in pairs]
        out = line_dedup.patience(mixed)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(out, out[1:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup(df).count() == 0


def test_a_block_whose_lines_come_first_from_different_documents(spark):
    block = [" ".join(f"w{i}x{j}" for j in range(10)) for i in range(4)]
    docs = [(10 * i + j, f"own {i} {j}\n{block[i]}\nend {i} {j}") for i in range(4) for j in range(9)]  # each line in over 8 documents
    docs += [(50, "\n".join(block)), (60, "\n".join(block)), (70, "head\n" + "\n".join(block[1:]) + "\ntail")]
    got = {d: (t, n) for d, t, n in run(spark, docs)}
    assert got[50] == (docs[-3][1], 0) and got[60] == ("", 4) and got[70] == ("head\ntail", 3)
    assert all(n == 0 for d, (_, n) in got.items() if d < 60)


def test_equals_the_alignments_with_all_earlier_documents(spark):
    r = random.Random(5)
    parts = [[f"p{i} l{j} x" for j in range(r.randint(2, 4))] for i in range(6)]
    docs = []
    for i in range(60):
        body = [x for p in r.sample(parts, r.randint(1, 5)) for x in p]  # blocks in any order
        body = [x for x in body if r.random() < 0.95]
        docs.append((i, "\n".join(body + [f"own {i}"] if r.random() < 0.5 else body)))
    want = {}
    for d, t in docs:
        mine, gone = t.split("\n"), set()
        for e, u in docs[:d]:
            theirs = u.split("\n")
            aligned = line_dedup.patience([(a, theirs.index(x), True) for a, x in enumerate(mine) if x in theirs])
            runs = []
            for a, b in aligned:
                if runs and runs[-1][-1] == (a - 1, b - 1):
                    runs[-1].append((a, b))
                else:
                    runs.append([(a, b)])
            gone |= {a for run_ in runs if sum(len(mine[a].split()) for a, _ in run_) >= 6 for a, _ in run_}
        want[d] = len(gone)
    assert {d: n for d, _, n in run(spark, docs, min_words=6)} == want


def test_two_documents_share_a_block_of_common_lines(spark):
    """One line of the block is only in these two; all others are in 13 more documents each."""
    block = [f"a{i} b c d e f" for i in range(7)]
    docs = [(1, "head one\n" + "\n".join(block) + "\ntail one"), (2, "head two\n" + "\n".join(block) + "\ntail two")]
    docs += [(10 + i * 13 + j, f"own {i} {j}\n{x}\nend {i} {j}") for i, x in enumerate(block) if i != 3 for j in range(13)]
    got = {d: (t, n) for d, t, n in run(spark, docs)}
    assert got[2] == ("head two\ntail two", 7) and sum(n for _, n in got.values()) == 7


def test_null_ids_repeated_rows_and_own_columns(spark):
    block = "\n".join(f"line {i} " + "w " * 10 for i in range(4))
    docs = [(None, block), (None, block), (1, block), (2, "x\n" + block), (2, "x\n" + block), (3, "y " * 30_000 + "\n" + block)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_deleted int")
    got = sorted(((r.doc_id or 0, r.n_deleted) for r in line_dedup.dedup(df).collect()))
    assert got == [(0, 0), (0, 0), (1, 0), (2, 4), (2, 4), (3, 4)]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "one two three\nfour five six", "x", "y", 3) for i in (1, 2)], "doc_id long, text string, `a.b` string, `c``d` string, c0_ int")
    out = line_dedup.dedup(df, min_words=4)
    assert out.columns == [*df.columns, "n_deleted"]
    assert sorted(map(tuple, out.collect())) == [(1, "one two three\nfour five six", "x", "y", 3, 0), (2, "", "x", "y", 3, 2)]
