"""Operator 3: exact token counts from a histogram of encoded lengths.

Every whole text is encoded; documents are aggregated by their number of tokens, combined before the shuffle. The
histogram is as long as there are distinct lengths, whatever the corpus. Its suffix sums answer totals, quantiles
and truncated totals for every context limit; they are built in two levels (within ranges of lengths, and over the
ranges), so that no task needs the whole histogram.

Defined cases: a null or empty text has 0 tokens and counts as a document; special tokens' strings are ordinary
text; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phylomill.stash import stash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGE = 1024


def encoder(vocabulary: str, pattern: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _lengths(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"length": pa.array(counts, pa.int64())})

    return run


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(length, n_docs): how many documents have so many tokens."""
    return docs.select("text").mapInArrow(_lengths(vocabulary, pattern), "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds for each length: docs and tokens of all documents at least as long, and the corpus's tokens and
    documents if texts are cut to this length (``truncated_tokens``) or if longer ones are left out (``docs_upto``,
    ``tokens_upto``). A length is the quantile of every share up to ``share_upto`` and above the last one's."""
    h = hist.withColumn("part", (F.col("length") / RANGE).cast("long")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    within = W.partitionBy("part").orderBy(F.desc("length"))
    h = h.join(parts, "part").withColumn("docs_from", F.sum("n_docs").over(within) + F.col("d")).withColumn("tokens_from", F.sum("tokens").over(within) + F.col("t"))
    longer_docs, longer_tokens = F.col("docs_from") - F.col("n_docs"), F.col("tokens_from") - F.col("tokens")
    return h.select(
        "length", "n_docs", "docs_from", "tokens_from",
        (F.col("all_docs") - longer_docs).alias("docs_upto"),
        (F.col("all_tokens") - longer_tokens).alias("tokens_upto"),
        (F.col("all_tokens") - longer_tokens + F.col("length") * longer_docs).alias("truncated_tokens"),
        ((F.col("all_docs") - longer_docs) / F.col("all_docs")).alias("share_upto"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, docs, tokens, truncated_tokens, docs_cut) for any context limits, whether a document has that length or not."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    longer, all_ = F.col("length") > F.col("context"), sums.agg(F.max("docs_from").alias("docs"), F.max("tokens_from").alias("tokens"))
    cut = asked.join(sums, longer, "left").groupBy("context").agg(F.coalesce(F.max("docs_from"), F.lit(0)).alias("docs_cut"), F.coalesce(F.max("tokens_from"), F.lit(0)).alias("over"))
    return cut.crossJoin(all_).select("context", "docs", "tokens", (F.col("tokens") - F.col("over") + F.col("context") * F.col("docs_cut")).alias("truncated_tokens"), "docs_cut")


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length that at least this share of all documents doesn't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    n = sums.agg(F.max("docs_from").alias("n"))
    return asked.crossJoin(n).join(sums, F.col("docs_upto") >= F.ceil(F.col("share") * F.col("n"))).groupBy("share").agg(F.min("length").alias("length"))


LIMITS = tuple(2**k for k in range(7, 21))
SHARES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def sums_of(spark, sf_dir: str) -> DataFrame:
    """The suffix sums of the table, written: both summaries read them twice."""
    return stash(op3_token_counts(spark, sf_dir), "sums")


def context_limits(spark, sf_dir: str) -> DataFrame:
    """Totals of the whole table at every context limit of ``LIMITS``."""
    return at_limits(sums_of(spark, sf_dir), LIMITS)


def length_quantiles(spark, sf_dir: str) -> DataFrame:
    """Quantiles of the length over the whole table."""
    return quantiles(sums_of(spark, sf_dir), SHARES)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    # written once: the sums read it twice, and encoding is the costly part
    return suffix_sums(stash(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "histogram"))
