"""Operator 12 against plain Python, and its defined cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from phylomill.llm import spelling as sp


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out = []
    forms = {}
    for w, n in words.items():
        near = [v for v in words if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        forms[w] = form
        out.append([w, form, None, n, len(near), words[form] if form else None])
    for r in out:
        root = r[0]
        while forms[root]:
            root = forms[root]
        r[2] = root
    return sorted(map(tuple, out))


def plain_vocabulary(docs, damage):
    count = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if damage and i is not None and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def test_vocabulary_equals_plain_python(spark):
    r = random.Random(5)
    names = ["Straße", "ÉCOLE", "garçon", "naïveté", "Weather", "weather", "ab", "x", "Übermut", "hello×there", "日本語", "over9under"]
    docs = [(i, "".join(r.choice(names) + r.choice([" ", "-", "1", "\n", "ß ", "’", "ā"]) for _ in range(r.randint(0, 80)))) for i in range(120)]
    docs += [docs[3], docs[3], (None, docs[4][1]), (500, None), (501, ""), (502, "long" * 60_000), (502, "Weather " * 60_000)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    for damage in (None, 3):
        assert {x.word: x.n for x in sp.vocabulary(df, damage=damage).collect()} == plain_vocabulary(docs, damage)


@pytest.mark.parametrize("most,span", [(2_000, 64), (6, 64), (6, 1)])
def test_near_words_equal_all_pairs(spark, monkeypatch, most, span):
    monkeypatch.setattr(sp, "SPAN", span)
    r = random.Random(most + span)
    words = {"".join(r.choice("abé") for _ in range(r.randint(5, 9))): r.randint(3, 60) for _ in range(250)}
    words |= {"a" * k: k for k in range(5, 12)} | {"prefix" + "".join(r.choice("abcd") for _ in range(4)): r.randint(3, 9) for _ in range(60)}
    words |= {"z" * 150: 9, "z" * 151: 30, "z" * 70 + "y" + "z" * 79: 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert sorted(map(tuple, sp.variants(df, most=most).collect())) == plain_variants(words)
    if most == 6:
        sizes = sp.initial_states(df, most).where("j - i > 1").groupBy("m", "i", "j", "before", "after").count()
        assert sizes.where(f"count > {most}").count() == 0


def test_acceptor_is_minimal_and_pairs_come_once():
    a = sp.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(a.arcs) == 5
    for seed in range(20):
        r = random.Random(seed)
        size = r.randint(1, 4)
        strings = sorted({"".join(r.choice("ab") for _ in range(size + r.randint(0, 1))) for _ in range(r.randint(1, 20))})
        got = [tuple(sorted(p)) for p in sp.one_edit_pairs(strings, size, 99)]
        want = {(x, y) for x in strings for y in strings if x < y and min(len(x), len(y)) == size and one_edit(x, y)}
        assert len(got) == len(set(got)) and set(got) == want


def test_joined_crc():
    r = np.random.default_rng(1)
    pairs = [(r.bytes(int(r.integers(0, 9))), r.bytes(int(r.integers(0, 40)))) for _ in range(200)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    got = sp.joined_crc(crc(0), crc(1), np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_chains_and_empty_tables(spark):
    words = {"colours": 3, "colour": 6, "color": 12, "colon": 24, "colony": 48}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root) for r in sp.variants(df).collect()}
    assert got["colours"] == ("colour", "colony") and got["colon"] == ("colony", "colony") and got["colony"] == (None, "colony")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sp.variants(sp.vocabulary(none)).collect() == []
    words, doc = sp.runs(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert isinstance(words, pa.DictionaryArray) and len(words) == 0 and len(doc) == 0
