"""What operators 2 and 4 share: windows of fixed length, grouped by content-chosen anchors.

Every window of a document belongs to one anchor (``textscan.anchors``); the windows of one anchor form a *segment*:
consecutive starts ``lo .. lo + n - 1``. Equal windows have equal anchor hashes (``cls``), so only segments whose
``cls`` occurs twice in the corpus can hold a repeated window, and equal segments (``seg``) hold equal windows
throughout. What is left for the expensive exact step is one copy of each distinct segment whose class has several.

A class with more than ``most`` such segments (a passage that very many documents have, in different surroundings) is
split: its windows are dealt by their distance from the anchor into narrow ranges, and what all windows of a range
have in common becomes part of the class. Equal windows stay together. At a range of one window the common part is
the window, so that no class stays large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from phylomill.llm import textscan as ts
from phylomill.stash import stash

SEGMENTS = "cls long, seg long, doc_id long, lo long, n int, parent long"
MOST_COPIED = 500_000  # copied segments are sent to all executors up to here (40 MB), and joined beyond
MOST_CLASSES = 1_000_000  # classes that are split are sent to all executors up to here (8 MB), and joined beyond


NO_ID = -(2**63)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text as empty; all other columns are dropped before anything is shuffled.

    A null doc_id becomes NO_ID. As no column can be null, an inner and an outer join with these rows read one and
    the same exchange.
    """
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def named(docs: DataFrame) -> DataFrame:
    """The rows of ``texts`` that have a doc_id; the others have no place among the documents."""
    return texts(docs).where(F.col("doc_id") != NO_ID)


def restored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_place(docs: DataFrame, f: Callable, schema: StructType, apart: tuple[str, ...] = ()) -> DataFrame:
    """``docs.mapInArrow(f, schema)`` for columns of any name, such as one with a dot or a backtick.

    mapInArrow resolves names itself and takes them for paths; so all columns but those in ``apart`` go by their places,
    there and back. ``schema`` has the columns of ``docs`` in their order, and new ones behind them.
    """
    short = {c: c if c in apart else f"c{k}_" for k, c in enumerate(docs.columns)}
    fields = [StructField(short.get(x.name, x.name), x.dataType, x.nullable) for x in schema.fields]
    out = docs.toDF(*short.values()).mapInArrow(f, StructType(fields))
    return out.toDF(*schema.names)


def quoted(names: list[str]) -> list[str]:
    """Column names as ``select`` takes them."""
    return ["`" + c.replace("`", "``") + "`" for c in names]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't among the distinct ``ids``; rows without a doc_id stay."""
    name = unused(docs, "gone_id")
    return docs.join(ids.withColumnRenamed("doc_id", name), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def candidates(segments: DataFrame, keep: bool = True) -> DataFrame:
    """Segments whose class occurs more than once: plus ``multi``, whether the class has distinct segments.

    ``keep``: write the segments, else make them twice (where they take much disk).
    """
    segments = stash(segments, "segments") if keep else segments
    classes = segments.groupBy("cls").agg(F.count("*").alias("c"), F.min("seg").alias("a"), F.max("seg").alias("b"))
    # written before it is joined: a join of two plain exchanges can split the rows of a very common class
    classes = stash(classes.where("c > 1").select("cls", (F.col("a") != F.col("b")).alias("multi")), "classes")
    return stash(segments.join(classes, "cls"), "candidates")


def split(cls: np.ndarray, at: np.ndarray, lo: np.ndarray, n: np.ndarray, levels: list[tuple[int, np.ndarray | None]], prefix: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(cls, lo, n, parent) of segments dealt into narrower ones, a level after the other.

    ``levels``: the width of each level's ranges, and which classes of the level above are split (None: all).
    ``prefix`` holds prefix sums of the units' hashes (``textscan.prefix_hash``), ``at`` the anchors.
    """
    parent = cls
    _, inv = ts.powers(len(prefix))
    for width, hot in levels:
        if hot is not None:
            ok = ts.among(hot, cls)
            cls, at, lo, n = cls[ok], at[ok], lo[ok], n[ok]
        least, most = (at - lo - n + 1) // width, (at - lo) // width
        times = most - least + 1
        row = np.repeat(np.arange(len(at)), times)
        r = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + least[row]
        parent, at, lo, n = cls[row], at[row], lo[row], n[row]
        end = np.minimum(lo + n - 1, at - r * width)
        lo = np.maximum(lo, at - r * width - width + 1)
        n = end - lo + 1
        a = at - r * width
        common = (prefix[a + length - width + 1] - prefix[a]) * inv[a]
        cls = ts.mix(ts.mix(parent + np.uint64(width)) + r.astype(np.uint64)) ^ ts.mix(common)
    return cls, lo, n, parent


def resolved(segments: Callable[[list[tuple[int, np.ndarray | None]]], DataFrame], widths: list[int], most: int, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """All candidates, and their distinct segments with copies, after large classes are split.

    ``segments(levels)`` makes the segments of the classes that ``levels`` (see ``split``) says.
    """
    levels: list[tuple[int, np.ndarray | None]] = []
    every: list[tuple[DataFrame, DataFrame]] = []
    above = None
    for width in [*widths, None]:
        rows = segments(levels)
        if above is not None:
            rows = rows.join(above.withColumnRenamed("cls", "parent"), "parent", "left_semi")
        found = candidates(rows.drop("parent"), keep)
        counted = stash(weighted(found), "distinct-segments")
        large = None
        if width is not None:
            large = stash(counted.where("multi").groupBy("cls").agg(F.count("*").alias("c")).where(F.col("c") > most).select("cls"), "large-classes")
            total = large.count()
            if not total:
                large = None
        if large is None:
            every.append((found, counted))
            break
        every.append(tuple(t.join(large, "cls", "left_anti").select(t.columns) for t in (found, counted)))
        few = total <= MOST_CLASSES
        levels = [*levels, (width, np.sort(np.array([r.cls for r in large.toLocalIterator()], np.int64).view(np.uint64)) if few else None)]
        above = None if few else large
    found, counted = every[0]
    for f, c in every[1:]:
        found, counted = found.unionByName(f), counted.unionByName(c)
    return found, counted


def weighted(found: DataFrame) -> DataFrame:
    """(cls, seg, copies, first): copies of each distinct segment and the earliest (doc_id, lo, n) of them."""
    return found.groupBy("cls", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "lo", "n")).alias("first"), F.first("multi").alias("multi"))


def copies_of(found: DataFrame, copied: DataFrame) -> DataFrame:
    """The rows of ``found`` whose segment is in ``copied``: a segment may have as many rows as the corpus."""
    few = copied.count() <= MOST_COPIED
    return found.join(F.broadcast(copied) if few else copied, ["cls", "seg"])


def with_texts(found: DataFrame, docs: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """Fetch the content of each distinct segment of a class that has several, from its earliest document."""
    per_doc = found.where("multi").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("cls", "copies", F.col("first.lo").alias("lo"), F.col("first.n").alias("n"))).alias("want"))
    return texts(docs).join(per_doc, "doc_id").mapInArrow(cut, schema)


def spans_by_doc(spans: DataFrame) -> DataFrame:
    """(doc_id, spans) with all (start, n) runs of windows of a document; no more than the document has anchors."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
