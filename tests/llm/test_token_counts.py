import math

from phylomill.llm import token_counts as tc

TEXTS = [None, "", "a", "hello world", "hello  world\n", "été 1234 <|endoftext|>", "x" * 3000, "hello world", "the of and " * 900]


def test_sums_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int").repartition(2)
    enc = tc.encoder(tc.VOCABULARY, tc.PATTERN)
    n = sorted(len(enc.encode_ordinary(t or "")) for t in TEXTS)
    sums = tc.suffix_sums(tc.histogram(df)).cache()
    want = sorted((x, n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), sum(y <= x for y in n), sum(y for y in n if y <= x), sum(min(x, y) for y in n), sum(y <= x for y in n) / len(n)) for x in set(n))
    assert sorted(map(tuple, sums.collect())) == want
    limits = [0, 1, 2, 3, 100, 2000, 10**6]
    assert sorted(map(tuple, tc.at_limits(sums, limits).collect())) == [(x, len(n), sum(n), sum(min(x, y) for y in n), sum(y > x for y in n)) for x in limits]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert sorted(map(tuple, tc.quantiles(sums, shares).collect())) == [(q, n[max(0, math.ceil(q * len(n)) - 1)]) for q in shares]
    assert tc.suffix_sums(tc.histogram(df.where("doc_id < 0"))).count() == 0


def test_pattern_is_the_vocabulary_owners():
    import public_tokenizers

    assert tc.encoder(tc.VOCABULARY, tc.PATTERN).encode_ordinary("It's 42, ça va?\n\n ok") == tc.encoder(tc.VOCABULARY, public_tokenizers.PATTERN).encode_ordinary("It's 42, ça va?\n\n ok")


def test_summaries_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    enc = tc.encoder(tc.VOCABULARY, tc.PATTERN)
    n = sorted(len(enc.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, tc.context_limits(spark, sf).collect())) == [(x, len(n), sum(n), sum(min(x, y) for y in n), sum(y > x for y in n)) for x in tc.LIMITS]
    assert sorted(map(tuple, tc.length_quantiles(spark, sf).collect())) == [(q, n[max(0, math.ceil(q * len(n)) - 1)]) for q in tc.SHARES]
