"""Newick trees, one to a line, and placements in jplace files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylomill.operators.scans import numbered

_TOKEN = re.compile(r"\s*(?:([(),;])|:\s*([^(),:;\s\[\]{}]+)|'((?:[^']|'')*)'|([^\s(),:;'\[\]{}]+)|(\[[^\]]*\])|\{(\d+)\})")


def parsed(text: str) -> list[tuple[str, str, float | None, int | None]]:
    """(parent, child, length, edge number) of a Newick text; nodes without a label are named ``_<order of closing>``."""
    out: list[list] = []
    open_: list[list[list]] = [[]]
    node: list | None = None
    serial = 0

    def close() -> None:
        nonlocal node, serial
        if node is None:
            node = ["", None, None, []]
        if not node[0]:
            node[0] = f"_{serial}"
            serial += 1
        for child in node[3]:
            out.append([node[0], child[0], child[1], child[2]])
        open_[-1].append(node)
        node = None

    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m.end() == at:
            break
        at = m.end()
        mark, length, quoted, label, _, number = m.groups()
        if mark == "(":
            open_.append([])
        elif mark in (",", ")", ";"):
            close()
            if mark == ")":
                children = open_.pop()
                node = ["", None, None, children]
            elif mark == ";":
                break
        else:
            node = node or ["", None, None, []]
            if length is not None:
                node[1] = float(length)
            elif number is not None:
                node[2] = int(number)
            elif quoted is not None or label is not None:
                node[0] = quoted.replace("''", "'") if quoted is not None else label
    return [tuple(x) for x in out]


def edges(lines: DataFrame) -> DataFrame:
    """(tree_id, parent, child, length, edge_num) of (tree_id, newick) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, *e) for t, text in zip(batch.tree_id, batch.newick) for e in parsed(text or "")]
            yield pd.DataFrame(rows, columns=["tree_id", "parent", "child", "length", "edge_num"]).astype({"length": "float64", "edge_num": "Int64"})

    return lines.select(F.col("tree_id").cast("string").alias("tree_id"), "newick").mapInPandas(run, "tree_id string, parent string, child string, length double, edge_num long")


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Trees of a file, numbered from 1 in order."""
    rows = spark.read.text(path).where("trim(value) != ''").withColumn("id", F.monotonically_increasing_id())
    return edges(numbered(rows, ["id"], "n").select((F.col("n") + 1).alias("tree_id"), F.col("value").alias("newick")))


def placements(files: DataFrame) -> DataFrame:
    """(file, query, edge_num, like_weight_ratio) of (file, json) rows in jplace form; fields are found by name."""
    schema = "tree string, fields array<string>, placements array<struct<p:array<array<double>>,n:array<string>,nm:array<array<string>>>>"
    rows = files.select("file", F.from_json("json", schema).alias("j")).select("file", "j.fields", F.explode("j.placements").alias("x"))
    names = F.coalesce("x.n", F.transform("x.nm", lambda p: p[0]))
    rows = rows.select("file", "fields", F.explode(names).alias("query"), F.col("x.p").alias("p")).select("file", "fields", "query", F.explode("p").alias("p"))
    value = lambda f: F.get("p", (F.array_position("fields", f) - 1).cast("int"))
    return rows.select("file", "query", value("edge_num").cast("int").alias("edge_num"), value("like_weight_ratio").alias("like_weight_ratio"))


def read_jplace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Placements and the tree edges with their edge numbers."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    tree = files.select(F.col("file").alias("tree_id"), F.get_json_object("json", "$.tree").alias("newick"))
    return placements(files), edges(tree)
