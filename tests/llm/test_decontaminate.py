from phylomill.llm import decontaminate as dc

ITEMS = [
    (1, "If Anna buys 12 apples for 3 euros and sells 12 of them again, how much does Anna keep after 5 days?"),
    (2, "the quick brown fox jumps over the lazy dog while nobody looks at it"),
    (3, "only six words are in here"),
    (4, "too short to count"),
    (5, None),
    (6, ""),
    (2, "the quick brown fox jumps over the lazy dog while nobody looks at it"),
]


def run(spark, docs, items=ITEMS):
    df = spark.createDataFrame([(*d, "h", 1) for d in docs], "doc_id long, text string, hash string, place int").repartition(2)
    it = spark.createDataFrame([(*x, "n") for x in items], "item_id long, text string, n string")
    return df, it, {(r.doc_id, r.item_id): r.exact for r in dc.matches(df, it).collect()}


DOCS = [
    (1, "Prelude here. If Anna buys 12 apples for 3 euros and sells 12 of them again, how much does Anna keep after 5 days? End."),
    (2, "Now if Bert buys 40 apples for 7 euros and sells 40 of them again, how much does Bert keep after 9 weeks?"),
    (3, "If Bert buys 40 apples for 7 euros and sells 41 of them again, how much does Carl keep after 9 weeks?"),
    (4, "THE QUICK, brown fox\njumps over the lazy dog while nobody looks"),
    (5, "the quick brown fox is all there is"),
    (6, None),
    (7, ""),
    (8, "well, only six words are in here, too short to count"),
    (9, "12 13 14 15 16 17 18 19 20 21 22 " * 40),
    (10, "filler words go on and on without an end " * 3000 + "the quick brown fox jumps over the lazy dog while nobody looks at it"),
    (4, "THE QUICK, brown fox\njumps over the lazy dog while nobody looks"),
]


def test_exact_and_reparameterised(spark):
    df, it, got = run(spark, DOCS)
    assert got == {(1, 1): True, (2, 1): False, (4, 2): True, (8, 3): True, (10, 2): True}
    kept = dc.decontaminate(df, it)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 9]


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    want = run(spark, DOCS)[2]
    monkeypatch.setattr(dc, "MOST_WINDOWS", 0)
    assert run(spark, DOCS)[2] == want


def test_empty_tables(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.matches(df, none).count() == 0 and dc.decontaminate(df, none).count() == len(DOCS)
    assert dc.matches(df.where("doc_id < 0"), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_planted_passages(spark):
    """Items stand whole in some documents; brute force by plain word windows."""
    sf = "/root/testdata/sf0.01"
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(d.doc_id, i) for d in docs for i, t in items.items() if f" {t} " in f" {' '.join(words(d.text))} "}
    got = {(r.doc_id, x) for r in dc.op1_decontaminate(spark, sf).collect() for x in r["items"]}
    assert want and got == want


def test_names_in_front_of_sentences_and_windows_of_values(spark):
    items = [
        (1, "Tom has 5 apples. Tom gives 2 to Ann. Tom buys 4 more of them. How many apples does Tom have now?"),
        (2, "12 + 13 = 25, 14 + 15 = 29, 16 + 17 = 33, 18 + 19 = 37, 20 + 21 = 41"),
        (3, "вчера утром Иван купил 5 яблок и потом Иван отдал 2 яблока своему другу"),
    ]
    docs = [
        (1, "Bert has 7 apples. Bert gives 3 to Eve. Bert buys 6 more of them. How many apples does Bert have now?"),
        (2, "See: " + items[1][1] + " and so on"),
        (3, "вчера утром Пётр купил 7 яблок и потом Пётр отдал 3 яблока своему другу"),
        (4, "Bert has 7 apples. Carl gives 3 to Eve. Dora buys 6 more of them. How many apples does Emil have now?"),
        (5, "12 + 13 = 26, 15 + 15 = 30, 16 + 18 = 34, 18 + 20 = 38, 20 + 22 = 42"),
        (6, "TOM HAS 5 APPLES. TOM GIVES 2 TO ANN. TOM BUYS 4 MORE OF THEM. HOW MANY APPLES DOES TOM HAVE NOW?"),
    ]
    assert run(spark, docs, items)[2] == {(1, 1): False, (2, 2): True, (3, 3): False, (6, 1): True}


def test_reparameterised_items_by_brute_force(spark):
    """Every item in many values; a document has an item if it was made of it."""
    import random

    r = random.Random(5)
    names = ["Anna Smith", "Bert", "Carla de Vries", "Dora", "Emil Jones", "Иван"]
    numbers = ["12", "forty", "twenty one", "3.5", "7", "nine", "1200", "thirty"]
    forms = [
        "yesterday {a} bought {x} apples at the market and then gave {y} of them to {b} on the way home",
        "a train leaves the station with {x} people and after the first stop {a} counts {y} more of them inside",
        "how many days does {a} need to paint {x} walls if {b} paints {y} walls in the same time",
    ]
    fill = lambda f: f.format(**dict(zip("ab", r.sample(names, 2))), **dict(zip("xy", r.sample(numbers, 2))))
    items = [(i, fill(f)) for i, f in enumerate(forms)]
    docs, want = [], set()
    for d in range(60):
        i = r.randrange(4)
        text = "filler words go on without any end here " * r.randint(0, 3)
        if i < 3:
            text, want = text + fill(forms[i]) + " and so the day ends with more words", want | {(d, i)}
        docs.append((d, text + " nothing to see in this place"))
    assert set(run(spark, docs, items)[2]) == want


def test_values_that_change_roles_are_no_copy(spark):
    items = [(1, "when Anna Smith has 12 coins and Bert has 3 coins then Anna Smith gives 12 coins to Bert who had 3 coins")]
    docs = [
        (1, "when Carl has forty coins and Dora Lee has 7 coins then Carl gives forty coins to Dora Lee who had 7 coins"),
        (2, "when Carl has forty coins and Dora Lee has 7 coins then Emil gives 9 coins to Anna who had 8 coins"),
    ]
    assert set(run(spark, docs, items)[2]) == {(1, 1)}


def test_clashing_names_null_ids_and_repeated_rows(spark):
    docs = [(None, ITEMS[0][1], 1), (1, ITEMS[0][1], 2), (1, ITEMS[0][1], 2), (2, None, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, gone_id int")
    it = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((r.doc_id or 0, r.gone_id) for r in dc.decontaminate(df, it).collect()) == [(0, 1), (2, 3)]


def test_names_behind_an_opening_word(spark):
    items = [(1, "Anna has 12 red apples in her basket. Later Anna buys 7 pears at the market and eats them.")]
    docs = [
        (1, "Bert has 30 red apples in her basket. Later Bert buys 8 pears at the market and eats them."),
        (2, "Bert has 30 red apples in her basket. Later Emil buys 8 pears at the market and eats them."),
        (3, "Bert Jones has 30 red apples in her basket. Later Bert Jones buys 8 pears at the market and eats them."),
    ]
    assert set(run(spark, docs, items)[2]) == {(1, 1), (3, 1)}


def test_common_nouns_are_no_names(spark):
    items = [(1, "Der Vater kauft am Morgen drei Brote und danach gibt Anna dem Kind zwei Brote davon ab.")]
    docs = [
        (1, "Der Onkel kauft am Abend vier Hefte und danach gibt Anna dem Lehrer fünf Hefte davon ab."),
        (2, "Der Vater kauft am Morgen vier Brote und danach gibt Bert dem Kind fünf Brote davon ab."),
    ]
    assert set(run(spark, docs, items)[2]) == {(2, 1)}


def test_diagonals_must_agree(spark):
    """The halves of an item stand in a document with other words between them, once with one buyer and once with two."""
    items = [(1, "when Anna bought 12 coins at the old market she was glad and because Anna bought 12 coins she had to carry them home in a bag")]
    first, second = "when {} bought {} coins at the old market she was glad", "and because {} bought {} coins she had to carry them home in a bag"
    docs = [(1, first.format("Bert", 30) + " for a long long time indeed " + second.format("Bert", 30)), (2, first.format("Bert", 30) + " for a long long time indeed " + second.format("Emil", 44))]
    df, it, _ = run(spark, docs, items)
    got = {r.doc_id: r.coverage for r in dc.matches(df, it, share=0.0).collect()}
    assert got[1] > 0.6 > 0.5 > got[2] > 0
