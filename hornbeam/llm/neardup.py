"""Near-duplicate documents: SimHash tiles, MinHash bands for what they miss, then an exact check.

Two documents link if the sets of their WORDS-word shingles have a Jaccard similarity of at least SIMILARITY. Equal
sets collapse first. Distinct ones are compared in two ways. The majority fingerprints of the sets go through the exact
tiles of ``simhash``, whose forest joins all that are linked by at most RADIUS differing bits. As few of the pairs at
SIMILARITY are that near, sets also meet where one of BANDS bands of ROWS MinHashes is equal: with the least and the
greatest set of that bucket. Every such pair is counted exactly before it links. Of what these links leave apart, every
pair that is within RADIUS bits or shares a band is then counted, too; a bucket's largest group does not meet itself, so a
large group of near copies stays linear. A pair of similarity 0.8 shares a band with probability
1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free, settle
from .simhash import RADIUS, majority, shingle_hashes
from .simhash import links as near_prints

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Documents that are sent to all executors at most, to fetch the texts to verify.
SENT = 500_000
#: A null doc_id is the last.
_LAST = 2**63 - 1
_draw = np.random.default_rng(17)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of the text's shingle hashes, in order."""
    return np.unique(shingle_hashes(text or b"", WORDS))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def bands(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
        prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        found = [bands(s) for s in sets]
        flat = np.array([x for f in found for x in f], np.uint64).view(np.int64)
        at = np.cumsum([0, *map(len, found)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["doc", "hash", "key", "size", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])


def _given(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, hash, key, size, fp, bands) of every row. doc: its number; hash: of its text; key, size, fp: of its set of shingles."""
    return _given(docs).mapInArrow(_signs, "doc long, hash long, key long, size int, fp long, bands array<long>")


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b of the keys to compare by their fingerprints, of ``prints`` (key, fp): equal ones with their least key, near ones by the tiles' forest."""
    of = settle(prints.groupBy("fp").agg(F.min("key").alias("least")))
    equal = prints.join(of, "fp").filter("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    end = lambda s, name: of.select(F.col("fp").alias(s), F.col("least").alias(name))
    tiled = near_prints(of.select("fp"), radius).distinct().join(end("a", "x"), "a").join(end("b", "y"), "b")
    return equal.union(tiled.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def band_pairs(each: DataFrame) -> DataFrame:
    """(a, b) with a < b of the keys to compare by their bands, of ``signatures``: the least and the greatest of a bucket with all of it.

    If ``each`` has a column label: all of a bucket that have unlike labels.
    """
    if "label" in each.columns:
        return apart(each.select("key", "label", "size", F.explode(F.array_distinct("bands")).alias("bucket")))
    keyed = each.select("key", F.explode("bands").alias("bucket")).distinct()
    ends = keyed.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    met = keyed.join(ends, "bucket").select("key", F.explode(F.array("low", "high")).alias("end")).filter("key <> end")
    return met.select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).distinct()


def apart(keyed: DataFrame, near: str = "true") -> DataFrame:
    """(a, b) with a < b: all pairs of keys of a bucket that have unlike labels and sizes of which SIMILARITY can be.

    keyed: (bucket, key, label, size), each key once in a bucket. near: SQL that a pair must fulfil, over a_fp and b_fp, say. The
    largest label of a bucket does not meet itself, others meet all: about as many rows are looked at as pairs are to compare.
    """
    open_ = settle(keyed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high and n > 2").select("bucket"))
    left = settle(keyed.join(open_, "bucket"))
    main = left.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    left = settle(left.join(main, "bucket"))
    l, r = (left.select(*(F.col(c).alias(f"{s}_{c}") for c in left.columns)) for s in "ab")
    once = (F.col("b_label") == F.col("b_main")) | (F.col("a_key") < F.col("b_key"))
    alike = F.least("a_size", "b_size") >= SIMILARITY * F.greatest("a_size", "b_size") - 1e-9
    met = l.filter("a_label <> a_main").join(r, (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_label") != F.col("b_label")) & once & alike & F.expr(near))
    return met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose sets have SIMILARITY, counted on the texts. prints: (key, doc, hash), a row of ``docs`` for each key."""
    pairs = settle(pairs)
    asked = settle(prints.select("key", "doc", "hash").join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key"))
    few = asked.count() <= SENT
    texts = _given(docs).join(F.broadcast(asked) if few else asked, ["doc", "hash"]).select("key", "text")
    sets = settle(texts.mapInArrow(_sets, "key long, shingles array<long>").dropDuplicates(["key"]))
    a, b = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return settle(both.filter(F.col("both") >= SIMILARITY * (F.size("x") + F.size("y") - F.col("both")) - 1e-9).select("a", "b"))


def links(each: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b) keys of sets whose components are those of all that link. prints: (key, doc, hash, size, fp), a row of ``docs`` for each key."""
    near = settle(near_pairs(prints.select("key", "fp")))
    found = verified(near.union(band_pairs(each)).distinct(), docs, prints)
    roots = settle(connected_components(found))
    known = roots.select(F.col("node").alias("key"), "root")
    named = lambda df: df.join(known, "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")
    # what is within RADIUS bits of anything is in one component of these pairs
    tiles = connected_components(near).select(F.col("node").alias("key"), F.col("root").alias("bucket"))
    by_prints = apart(named(tiles.join(prints.select("key", "size", "fp"), "key")), f"bit_count(a_fp ^ b_fp) <= {RADIUS}")
    rest = by_prints.union(band_pairs(named(each.select("key", "size", "bands").dropDuplicates(["key"])))).distinct()
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(rest, docs, prints))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that with the smallest doc_id; null is the largest.

    Columns stay as they are. Exact repeats of a kept row stay with it. Texts without words are one group.
    """
    kept, kept_hash = free(docs.columns, "kept", "kept_hash")
    each = settle(signatures(docs))
    prints = settle(each.groupBy("key").agg(F.min("doc").alias("doc"), F.min_by("hash", "doc").alias("hash"), F.min("size").alias("size"), F.min("fp").alias("fp")))
    roots = settle(connected_components(links(each, docs, prints)))
    of = prints.join(roots, prints["key"] == roots["node"], "left")
    grouped = of.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc", "hash")).alias("kept")).select("kept.doc", "kept.hash")
    keep = settle(grouped.union(of.filter("root is null").select("doc", "hash"))).select(F.col("doc").alias(kept), F.col("hash").alias(kept_hash))
    row = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col(kept)) & (F.xxhash64(F.col("text").cast("string")) == F.col(kept_hash))
    return docs.join(keep, row, "left_semi")
