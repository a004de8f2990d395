"""Operator 9: line dedup by pairwise alignment.

The n-th repetition of a line within a document is a line of its own, so a line has one place in a document. Any block
that two documents share and that is long enough to be deleted holds a window of adjacent lines that just reaches
``MIN_WORDS``, starting or ending at one of its lines. Documents are therefore found through the hashes of such
windows, however common a line or window is: each document is paired with the first holder of each of its windows,
and all lines that both have enter the pair's alignment. The lines that occur once on either side are aligned as in a
patience diff: the longest run of matches in increasing order on both sides are the anchors, and matches of repeated
lines are added where they fit between them. Runs of aligned adjacent lines with ``MIN_WORDS`` words or more are
deleted from the later document.

Pairs are as many as the windows, thus linear in the lines. Where the order of lines in a pair leaves a shared window
out, the document is paired with the other earlier holders of that window as well, the latest first and twice as many
in each round, until the window is deleted or has no further holder. So what goes is what the alignments with all
earlier documents would delete.

Defined cases: lines are separated by \\n; lines without a word are neither aligned nor deleted; a null text stays
null; a row without a doc_id is left alone; equal documents lose all lines but the first's, when long enough;
repeated rows of one doc_id are one document; an own column n_deleted is replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby
from struct import pack

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from phylomill.llm.quality_rules import BLANK
from phylomill.llm.repeats import by_place, quoted, unused
from phylomill.stash import stash

MIN_WORDS = 20


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at, key, words, once): each line with a word; ``at`` counts such lines, ``once``: not repeated in it."""
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(kept).alias("at", "line"))
    rows = rows.select("doc_id", "at", F.xxhash64("line").alias("hash"), F.size(F.split(F.btrim("line", F.lit(BLANK)), r"[\x20\x09-\x0D]+")).alias("words")).dropDuplicates(["doc_id", "at"])
    same = W.partitionBy("doc_id", "hash")
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy("at"))).withColumn("once", F.count("*").over(same) == 1)
    return rows.select("doc_id", "at", F.when(F.col("nth") == 1, F.col("hash")).otherwise(F.xxhash64("hash", "nth")).alias("key"), "words", "once")


def _windows(min_words: int):
    """Rows (doc_id, at, n, hash): the shortest windows with ``min_words`` words that start or end at a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(x).to_pylist() for x in ("doc_id", "at", "key", "words")))

        out: list[tuple[int, int, int, int]] = []
        for (doc, _), group in groupby(enumerate(rows()), key=lambda r: (r[1][0], r[1][1] - r[0])):
            group = [r for _, r in group]  # lines that follow each other
            data, upto = pack(f"<{len(group)}q", *(r[2] for r in group)), [0, *accumulate(r[3] for r in group)]
            spans = {(i, bisect_left(upto, upto[i] + min_words, i + 1)) for i in range(len(group))}
            spans |= {(bisect_right(upto, upto[j] - min_words, 0, j) - 1, j) for j in range(1, len(upto))}
            out += [(doc, group[i][1], j - i, xxhash.xxh3_64_intdigest(data[8 * i : 8 * j]) - 2**63) for i, j in spans if i >= 0 and j < len(upto)]
            if len(out) >= 10_000:
                yield _spans(out)
                out = []
        yield _spans(out)

    return run


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    doc, at, n, key = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int32()), "hash": pa.array(key, pa.int64())})


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_lines(found: DataFrame) -> DataFrame:
    """The lines that several documents have."""
    keys = found.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    keys = stash(keys, "shared-keys")  # so that the join can split the rows of a very common line
    return stash(found.join(keys, "key"), "shared-lines")


def shared_windows(shared: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, at, n, hash, first): windows that several documents have, and their first holder."""
    ordered = shared.select("doc_id", "at", "key", "words").repartition(_parts(shared), "doc_id").sortWithinPartitions("doc_id", "at")
    rows = stash(ordered.mapInArrow(_windows(min_words), "doc_id long, at int, n int, hash long"), "windows")
    first = stash(rows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("df")).where("df > 1").drop("df"), "first-holders")
    return stash(rows.join(first, "hash"), "shared-windows")


def matches(shared: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, other, at, other_at, words, once): all lines that both documents of a pair have."""
    mine = stash(shared.join(pairs, "doc_id"), "pair-lines")
    theirs = shared.join(pairs.select(F.col("other").alias("doc_id")).distinct(), "doc_id", "left_semi")
    theirs = stash(theirs.select(F.col("doc_id").alias("other"), "key", F.col("at").alias("other_at"), F.col("once").alias("other_once")), "holder-lines")
    return mine.join(theirs, ["other", "key"]).select("doc_id", "other", "at", "other_at", "words", (F.col("once") & F.col("other_once")).alias("once"))


def _increasing(pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of a longest run of pairs, sorted by the first member, whose second members increase."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1] = [b]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(pairs: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Aligned (at, other_at) of matches (at, other_at, once), sorted by at."""
    anchor = [(a, b) for a, b, once in pairs if once]
    anchor = [anchor[i] for i in _increasing(anchor)]
    out, k, gap = [], 0, []
    low = -1
    for a, b, once in [*pairs, (1 << 60, 1 << 60, True)]:
        end = k < len(anchor) and anchor[k] == (a, b) or a == 1 << 60
        if end:
            fit = [(x, y) for x, y in gap if low < y < b]
            out += [fit[i] for i in _increasing(fit)]
            gap, low, k = [], b, k + 1
            if a < 1 << 60:
                out.append((a, b))
        elif not once:
            gap.append((a, b))
    return out


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(x).to_pylist() for x in ("doc_id", "other", "at", "other_at", "words", "once")))

        out: list[tuple[int, int, int]] = []
        for (doc, _), group in groupby(rows(), key=lambda r: r[:2]):
            group = list(group)
            words = {r[2]: r[4] for r in group}
            block: list[int] = []
            last = (-9, -9)
            for a, b in [*patience([(r[2], r[3], r[5]) for r in group]), (-9, -9)]:
                if (a, b) != (last[0] + 1, last[1] + 1):
                    if block and sum(words[x] for x in block) >= min_words:
                        out.append((doc, block[0], len(block)))
                    block = []
                block.append(a)
                last = (a, b)
            if len(out) >= 10_000:
                yield _blocks(out)
                out = []
        yield _blocks(out)

    return run


def _blocks(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    doc, start, n = zip(*rows) if rows else ((), (), ())
    return pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32())})


def _left(windows: DataFrame, gone: DataFrame) -> DataFrame:
    """Windows with a line outside of the blocks in ``gone``."""
    by_doc = gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", F.col("n").alias("k"))).alias("gone"))
    inside = F.forall(F.sequence("at", F.col("at") + F.col("n") - 1), lambda i: F.exists("gone", lambda g: (i >= g["start"]) & (i < g["start"] + g["k"])))
    return windows.join(by_doc, "doc_id", "left").where(~F.coalesce(inside, F.lit(False))).drop("gone")


def blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, n): aligned common blocks that are to be deleted, in lines with a word."""
    shared = shared_lines(stash(lines(docs), "lines"))
    windows = shared_windows(shared, min_words)

    def aligned(pairs: DataFrame) -> DataFrame:
        found = matches(shared, stash(pairs.distinct(), "pairs")).repartition(_parts(docs), "doc_id", "other").sortWithinPartitions("doc_id", "other", "at")
        return stash(found.mapInArrow(_align(min_words), "doc_id long, start int, n int"), "blocks")

    later = windows.where("doc_id > first")
    gone = aligned(later.select("doc_id", F.col("first").alias("other")))
    left = stash(_left(later, gone), "left")
    if left.isEmpty():
        return gone
    # the holders of these windows, numbered from the first
    holders = windows.join(left.select("hash").distinct(), "hash", "left_semi").select("hash", "doc_id", F.row_number().over(W.partitionBy("hash").orderBy("doc_id")).alias("rank"))
    holders = stash(holders, "holders")
    left = stash(left.join(holders, ["hash", "doc_id"]).withColumn("rank", F.col("rank") - 1), "left")
    step = 1
    while not (left := left.where("rank > 1")).isEmpty():  # rank: holders not yet tried, the first among them, which was
        asked = left.select("doc_id", "hash", F.explode(F.sequence(F.greatest(F.col("rank") - (step - 1), F.lit(2)), F.col("rank"))).alias("rank"))
        more = aligned(asked.join(holders.withColumnRenamed("doc_id", "other"), ["hash", "rank"]).select("doc_id", "other"))
        gone = gone.unionByName(more)
        left = stash(_left(left, more).withColumn("rank", F.col("rank") - step), "left")
        step *= 2
    return gone


def _delete(gone_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(gone_name).to_pylist()):
                if gone:
                    drop = {x for g in gone for x in range(g["start"], g["start"] + g["n"])}
                    kept, at = [], 0
                    for line in text.split("\n"):
                        if line.strip(BLANK):
                            at += 1
                            if at - 1 in drop:
                                continue
                        kept.append(line)
                    text = "\n".join(kept)
                    counts.append(len(drop))
                else:
                    counts.append(0)
                texts.append(text)
            i, j = batch.schema.get_field_index("text"), batch.schema.get_field_index(gone_name)
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type)).set_column(j, "n_deleted", pa.array(counts, pa.int64()))

    return run


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the common blocks deleted from each text, and n_deleted, the number of deleted lines."""
    docs = docs.drop("n_deleted")
    gone, own = unused(docs, "gone_"), unused(docs, "id_")
    found = blocks(docs, min_words).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start", "n")).alias(gone))
    out = docs.join(found.hint("shuffle_merge"), F.col("doc_id").cast("long") == F.col(own), "left").select(*quoted(docs.columns), gone)
    return by_place(out, _delete(gone), StructType([*docs.schema.fields, StructField("n_deleted", LongType())]), ("text", gone))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    return dedup(docs).select("doc_id", (n + F.col("n_deleted")).cast("long").alias("n_lines"), "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
