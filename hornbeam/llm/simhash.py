"""SimHash near-duplicates by exact tiled comparison.

Every document gets a 64-bit majority fingerprint of its word shingles. Equal fingerprints collapse first; the
distinct ones are dealt into tiles of one population count each, and only tile pairs whose counts differ by at most
the radius meet (the Hamming distance is never below that difference). A pair of tiles is compared with numpy
exclusive-or and bit counts, and gives a spanning forest of its links, not the links themselves, so a large group of
near copies stays linear. Components of those forests are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, connected_components, free, settle, table

SEED = 42
WORDS = 4
RADIUS = 4
_LANE = np.uint64(0x0001000100010001)
_FULL = 65535


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words; of the whole sequence if it has fewer; none without words."""
    found = text.translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bit k is set if it is set in more than half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _FULL):  # 16-bit lanes can't overflow
        part = hashes[at : at + _FULL]
        for shift in range(16):
            lanes = int(((part >> np.uint64(shift)) & _LANE).sum(dtype=np.uint64))
            for lane in range(4):
                ones[shift + 16 * lane] += lanes >> (16 * lane) & 0xFFFF
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        prints = np.array([majority(shingle_hashes(t or b"", words)) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp), fp the fingerprint's 64 bits as a signed number. Null text: no words, fingerprint zero."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, fp long")


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest, as (print, root) pairs, of the links within radius: inside ``left``, or between both tiles."""
    alone = right is None
    nodes = left if alone else np.concatenate([left, right])
    parent, base = np.arange(len(nodes)), 0 if alone else len(left)
    other = left if alone else right
    rows = max(1, (1 << 16) // max(1, len(other)))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ other[None, :]) <= radius
        for r in np.flatnonzero(near.sum(axis=1) > (1 if alone else 0)).tolist():
            meet = np.append(np.flatnonzero(near[r]) + base, at + r)
            root = parent[meet]
            while not np.array_equal(up := parent[root], root):
                root = up
            root = np.unique(root)
            parent[root] = root[0]
            parent[meet] = root[0]
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return list(zip(nodes[moved].view(np.int64).tolist(), nodes[parent[moved]].view(np.int64).tolist()))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) prints whose components are those of all links within radius. ``prints``: distinct fp.

    Tiles hold about 8 * sqrt(number of prints) of them, from 1,024 up to 65,536. Only the histogram of population
    counts (65 rows) comes to the driver.
    """
    counts = {r["p"]: r["n"] for r in prints.groupBy(F.bit_count("fp").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = min(65536, max(1024, 8 * math.isqrt(sum(counts.values()))))
    chunks = [-(-counts.get(p, 0) // size) for p in range(65)]
    first = [sum(chunks[:p]) for p in range(66)]  # tiles are numbered by population count
    number = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1).cast("long")
    p = F.bit_count("fp")
    tile = number(first, p) + F.pmod(F.xxhash64("fp"), number(chunks, p))
    low, high = number(first, F.greatest(p - radius, F.lit(0))), number(first, F.least(p + radius, F.lit(64)) + 1)
    met = prints.withColumn("tile", tile).select("fp", "tile", F.explode(F.sequence(low, high - 1)).alias("other"))
    met = met.select("fp", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") <= F.col("other")).alias("left"))

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        fp = pair["fp"].to_numpy(np.int64).view(np.uint64)
        left = pair["left"].to_numpy(bool)
        alone = pair["low"].iloc[0] == pair["high"].iloc[0]
        return pd.DataFrame(forest(fp, None, radius) if alone else forest(fp[left], fp[~left], radius), columns=["a", "b"], dtype="int64")

    return met.groupBy("low", "high").applyInPandas(compare, "a long, b long")


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links of at most ``radius`` bits.

    One row for each input row. Rows that repeat a doc_id keep their own fingerprints; a null doc_id stays null and
    counts as the largest. Texts without words share fingerprint zero, so they are one group.
    """
    each = settle(fingerprints(docs, words))
    prints = settle(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settle(connected_components(links(prints.select("fp"), radius)))
    of = prints.join(roots, prints["fp"] == roots["node"]).select("root", "fp", "least")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = of.join(least, "root").select("fp", "component_id")
    owner = prints.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return each.join(owner, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that with the smallest doc_id.

    Columns stay as they are. Rows that repeat the kept doc_id stay with it if their texts are equal or near.
    """
    (kept,) = free(docs.columns, "kept")
    found = near_groups(docs, words, radius)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(kept)), "left_semi")
