import random

import pytest

from phylomill.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def m():
    return sp.Model()


@pytest.fixture(scope="module")
def scores():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(sp.MODEL, "rb").read())
    return {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}


def brute(text, scores, m):
    """Plain Viterbi over the whole text; (score, ids)."""
    t = m.escaped(text)
    best = [(0.0, [])] + [None] * len(t)
    for i in range(1, len(t) + 1):
        found = []
        for n in range(1, min(i, 16) + 1):
            w = t[i - n : i]
            if w in scores:
                found.append((best[i - n][0] + scores[w][1], -n, best[i - n][1] + [scores[w][0]]))
            elif n == 1:
                found.append((best[i - 1][0] + m.unknown, -1, best[i - 1][1] + [int(m.byte_ids[b]) for b in w.encode()]))
        top = max(found)
        best[i] = (top[0], top[2])
    return best[-1][1]


TEXTS = ["", " ", "a", "hello world", "  two  blanks ", "tab\tand\nline\n", "été Ñandú ß", "日本語 🙂🙂 x", "x" * 400, "▁own▁", "\x00\x7f", "internationalization of representations"]


def corpus(seed):
    r = random.Random(seed)
    return [" ".join("".join(r.choice("etaoinshrdlué🙂\n ") for _ in range(r.randint(0, 20))) for _ in range(r.randint(0, 30))) for _ in range(60)]


def test_equals_brute_force(m, scores):
    for texts in (TEXTS, corpus(1), []):
        ids, off = m.encode_batch(texts)
        for k, t in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == brute(t, scores, m), t


def test_round_trip_and_library_decoding(m):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    for t in TEXTS + corpus(2):
        ids, _ = m.encode_batch([t])
        assert m.decode(ids.tolist()) == t.replace("▁", " ")
        assert lib.decode(ids.tolist()) == m.decode(ids.tolist())


def test_tables(spark, m):
    df = spark.createDataFrame([(i, t, [1], "p") for i, t in enumerate([None, *TEXTS])], "doc_id long, text string, pieces_ array<int>, ids string")
    rows = sp.decode(sp.encode(df)).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in rows) and rows[0].ids == "p"
    got = sp.digest(df).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.round_trip for r in got)
    assert sp.encode(df.where("doc_id < 0")).count() == 0


def test_long_units(m, scores, monkeypatch):
    """Texts without blanks, in windows much smaller than they are."""
    r = random.Random(4)
    monkeypatch.setattr(sp, "WINDOW", 257)
    han = "".join(r.choice("日本語中文字国人大学生年月東京都市会社員工場的是不了在有我他") for _ in range(1500))
    texts = ["x" * 2000, "ab" * 600, "".join(r.choice("etaoinshrdlu") for _ in range(1500)), han, "é🙂" * 300, "1234567890" * 50, "▁" * 300, "the" * 200 + " " + "a" * 500 + " " + "a" * 500]
    ids, off = m.encode_batch(texts)
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == brute(t, scores, m), k


def test_own_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "p", 2), (None, None, "p", 2)], "doc_id long, text string, pieces string, `a-b c` int")
    rows = sp.checked(df).collect()
    assert [r["a-b c"] for r in rows] == [2, 2] and all(r.round_trip for r in rows) and sorted(len(r.pieces) > 0 for r in rows) == [False, True]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "hello world", "x", "y", 3)], "doc_id long, text string, `a.b` string, `c``d` string, c0_ int")
    for out in (sp.encode(df), sp.checked(df), sp.decode(sp.encode(df))):
        r = out.first()
        assert out.columns[:5] == df.columns and tuple(r)[:5] == (1, "hello world", "x", "y", 3)
    assert r["decoded"] == "hello world"
