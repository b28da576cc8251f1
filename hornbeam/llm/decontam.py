"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest is kept (the rightmost of equal ones), in the benchmark and
in the documents alike. With k-grams of K words and windows of SPAN - K + 1 of them, every shared run of SPAN words
has a kept hash in common; the hits are joined on it and extended word by word as far as both sides agree, so nothing
is reported on a hash alone.

The benchmark is the side that is sent out, in blocks of bounded size, one at a time; documents are never shuffled.
A larger benchmark means more passes over them: after each block but the last what is found so far is written to the
shared folder with the documents, and the block is given up before the next one is sent.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, settle, table

SPAN = 10
K = 5
#: Bytes of benchmark text in a block, about.
BLOCK_BYTES = 16 << 20
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MAX = np.uint64(2**64 - 1)


def words(text: bytes | None) -> list[bytes]:
    """ASCII digits and letters (lower-cased) and everything beyond ASCII make words."""
    return (text or b"").translate(_WORD).split()


def winnow(ids: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes kept; ids: word numbers, 0 for words the benchmark doesn't have."""
    k = min(K, span)
    n = len(ids) - k + 1
    if n < span - k + 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
        known &= part > 0
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    hashes[~known] = _MAX
    width = span - k + 1
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)
    at = np.unique(np.arange(len(view)) + width - 1 - view[:, ::-1].argmin(axis=1))
    at = at[known[at]]
    return at, hashes[at]


class Index:
    """A block of the benchmark: its words, and its kept hashes by span length."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names, self.items, self.number = [], [], {}
        for name, text in items:
            found = words(text)
            if found:
                self.names.append(name)
                self.items.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in found], np.int64))
        self.spans: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for j, ids in enumerate(self.items):
            span = min(SPAN, len(ids))
            for at, h in zip(*(x.tolist() for x in winnow(ids, span))):
                self.spans[span][h].append((j, at))
        self.spans = {span: dict(of) for span, of in self.spans.items()}
        self.sorted = {span: np.array(sorted(of), np.uint64) for span, of in self.spans.items()}

    def find(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of ``found`` inside occurrences of windows, and the names of the items they are of."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in found], np.int64)
        ranges, names = [], set()
        gaps = np.flatnonzero(np.concatenate([[True], ids == 0, [True]]))
        longest = int(np.diff(gaps).max()) - 1  # run of words that the benchmark has
        for span, kept in self.sorted.items():
            if longest < span:
                continue
            at, hashes = winnow(ids, span)
            place = np.searchsorted(kept, hashes)
            hit = kept[np.minimum(place, len(kept) - 1)] == hashes
            done: dict[tuple[int, int], int] = {}
            for p, h in zip(at[hit].tolist(), hashes[hit].tolist()):
                for j, q in self.spans[span][h]:
                    if done.get((j, p - q), -1) > p:
                        continue
                    item = self.items[j]
                    back, ahead = min(p, q), min(len(ids) - p, len(item) - q)
                    differ = np.flatnonzero(ids[p - back : p + ahead] != item[q - back : q + ahead])
                    cut = int(np.searchsorted(differ, back))
                    left = int(differ[cut - 1]) + 1 if cut else 0
                    right = int(differ[cut]) if cut < len(differ) else back + ahead
                    done[j, p - q] = max(p + 1, p - back + right)
                    if right - left >= span:
                        ranges.append((p - back + left, p - back + right))
                        names.add(self.names[j])
        return ranges, names


def _pass(batches: Iterator[pa.RecordBatch], block, text: int, last: bool) -> Iterator[pa.RecordBatch]:
    """The last column has what earlier blocks found: flat word ranges and item names."""
    index = block.value if block else Index([])
    for batch in batches:
        before = batch.column(batch.num_columns - 1).to_pylist()
        out = []
        for t, was in zip(batch.column(text).cast(pa.binary()).to_pylist(), before):
            found = words(t)
            ranges, names = index.find(found) if found and index.items else ([], set())
            ranges, names = ranges + list(zip(was["r"][::2], was["r"][1::2])), names | set(was["i"])
            if not last:
                out.append({"r": [x for r in ranges for x in r], "i": sorted(names)})
                continue
            mask = np.zeros(len(found), bool)
            for a, b in ranges:
                mask[a:b] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            out.append({"n_words": len(found), "n_hit": int(mask.sum()), "n_items": len(names), "items_sha256": hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), "contaminated": bool(mask.any()), "ranges": edges.tolist()})
        kind = _PA_LAST if last else _PA_STATE
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], batch.schema.names)


_STATE = "struct<r:array<int>,i:array<string>>"
_LAST = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean,ranges:array<int>>"
_PA_STATE = pa.struct([("r", pa.list_(pa.int32())), ("i", pa.list_(pa.string()))])
_PA_LAST = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("ranges", pa.list_(pa.int32()))])


def mark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, name: str = "found") -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, n_items, items_sha256, contaminated, ranges of hit words.

    A null or empty text has no words and is clean. An item without words is never met; a null item_id counts as an
    empty one, rows that repeat an item_id as one item. An empty benchmark leaves every document clean. Rows of
    ``docs`` stay as they are, repeated ones too.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = docs.withColumn(name, F.expr(f"cast(named_struct('r', array(), 'i', array()) as {_STATE})"))
    text = docs.columns.index("text")
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        block = sc.broadcast(Index(sorted({(r["item"], r["text"].encode()) for r in rows})))
        last = k == blocks - 1
        kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        out = out.mapInArrow(lambda it, block=block, last=last: _pass(it, block, text, last), f"{kinds}, `{name}` {_LAST if last else _STATE}")
        if not last:
            out = settle(out)
            block.destroy()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(f"found.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that have a word of a benchmark window; columns stay as they are."""
    (name,) = free(docs.columns, "found")
    return mark(docs, benchmark, name=name).filter(~F.col(f"{name}.contaminated")).drop(name)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda i: array_to_string(ws[i : i + 9], ' '))) AS win FROM b WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, lens.n AS n, unnest(range(1, len(ws) - lens.n + 2)) AS p, ws FROM w, lens WHERE len(ws) >= lens.n),
hit AS (SELECT doc_id, item_id, p, dw.n AS n FROM dw JOIN bw ON bw.n = dw.n AND bw.win = array_to_string(ws[p : p + dw.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
