"""Fact files (tab separated, no header), output files, and frames as relations."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.language import Decl
from hornbeam.operators.fixpoint import empty
from hornbeam.operators.rule import HIDDEN, columns


class FactsError(ValueError):
    """A fact file with a row that is none of its relation."""


def bind(df: DataFrame, decl: Decl) -> DataFrame:
    """A frame's columns, in order, as a relation's. Rows with nulls are left out, as the language has no null."""
    if len(df.columns) != max(1, len(decl.columns)) and decl.columns:
        raise ValueError(f"{decl.name} has {len(decl.columns)} columns, the frame {len(df.columns)}")
    if not decl.columns:
        return df.limit(1).select(F.lit(1).alias(HIDDEN))
    kinds = {"number": "long", "symbol": "string"}
    picked = df.toDF(*columns(len(decl.columns))).select(*(F.col(f"c{k}").cast(kinds[t]).alias(f"c{k}") for k, (_, t) in enumerate(decl.columns)))
    return picked.na.drop()


def load(spark: SparkSession, folder: str, decl: Decl) -> DataFrame:
    """``<folder>/<relation>.facts``; a missing file is an empty relation.

    Rows end at line feeds alone; one carriage return before is no data. Numbers are signed decimal 64-bit numbers
    without spaces, symbols any text without NUL. A row that isn't such is an error. For a relation without columns
    a row (empty or ``()``) makes it true.
    """
    path = f"{folder.rstrip('/')}/{decl.name}.facts"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty(spark, decl)
    rows = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    n = len(decl.columns)
    if not n:
        good = F.col("row").isin("", "()")
        _refuse(rows, good, path)
        return rows.limit(1).select(F.lit(1).alias(HIDDEN))
    parts = rows.select("*", F.split("row", "\t", -1).alias("part"))
    good = F.size("part") == n
    for k, (_, kind) in enumerate(decl.columns):
        part = F.get("part", F.lit(k))
        good &= F.coalesce(part.rlike("^[+-]?[0-9]+$") & F.expr(f"try_cast(part[{k}] as bigint)").isNotNull() if kind == "number" else ~part.contains("\x00"), F.lit(False))
    _refuse(parts, F.coalesce(good, F.lit(False)), path)
    return parts.select(*((F.expr(f"try_cast(get(part, {k}) as bigint)") if kind == "number" else F.get("part", F.lit(k))).alias(f"c{k}") for k, (_, kind) in enumerate(decl.columns)))


def _refuse(rows: DataFrame, good: Column, path: str) -> None:
    """An error with the line of the first row that isn't ``good``. Lines are counted over the blocks that Spark reads a file in."""
    if rows.filter(~good).isEmpty():
        return
    # rows of a block come one after the other, in a partition that may hold other blocks too
    placed = rows.select("row", "file", "block", F.monotonically_increasing_id().alias("at"), (~good).alias("bad"))
    blocks = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min_by("row", F.when(F.col("bad"), F.col("at"))).alias("row"), F.min(F.when(F.col("bad"), F.col("at"))).alias("at"))
    before = 0
    for b in blocks.orderBy("file", "block").toLocalIterator():  # one row for each block of a file
        if b["block"] == 0:
            before = 0
        if b["at"] is not None:
            raise FactsError(f"{b['file']}:{before + b['at'] - b['first'] + 1}: a row does not fit its relation: {b['row'][:200]!r}")
        before += b["n"]


def lines(df: DataFrame) -> DataFrame:
    """A relation's tuples as text rows."""
    if df.columns == [HIDDEN]:
        return df.select(F.lit("()").alias("value"))
    return df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns)).alias("value"))


def write(df: DataFrame, folder: str, name: str) -> str:
    """``<folder>/<name>.csv`` as one local file, streamed through the driver; for large results use ``lines(df).write.text``."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.csv")
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(f"{r[0]}\n" for r in lines(df).toLocalIterator())
    return path
