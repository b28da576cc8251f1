"""Packing by power-of-two decomposition.

Each document's token ids, ended by one further id, are cut into pieces whose lengths are the powers of two in the
binary form of its length (full sequences first). A piece is a sequence of its own: nothing crosses documents, nothing
is padded, and pieces of one length share a bucket: they lie together within each partition, numbered in turn, and
``write_buckets`` writes a folder for each length, so that batches of equal shape are drawn without looking.

Ids are those of a public BPE tokenizer. White space never reaches its vocabulary, so the ids of a text are those of
its chunks in turn; each worker remembers chunks it has seen and encodes a new one only once. Spark keeps a worker after its
last task, so one that has nothing to encode for IDLE seconds gives the memory back: other stages need it.
"""

from __future__ import annotations

import ctypes
import re
import threading
import time
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GROUP_BYTES, LOWER, groups, table

VOCABULARY = "word_bpe_49k.json"
END = 2
LONGEST = 4096
#: Chunks, bytes of chunks, and ids that a worker remembers, about, before it starts anew.
REMEMBERED, REMEMBERED_BYTES, REMEMBERED_IDS = 1_200_000, 64 << 20, 16 << 20
#: Seconds without a text after which a worker forgets them.
IDLE = 2.0
#: A chunk of Latin-1's printable characters, without what the tokenizer treats as a whole (contractions, special
#: tokens); and what such a chunk is cut into: runs of letters, single digits, runs of anything else.
_PLAIN = re.compile("[!-&(-;=-~¡-ÿ]+")
_PARTS = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        last = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(max(last) + 1, bool)
        self.ends[last] = True
        self.lock, self.used, self.watched = threading.Lock(), 0.0, False
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.parts: dict[str, array] = {}
        self.starts, self.lengths, self.pool, self.bytes = Growing(np.int64), Growing(np.int64), Growing(np.uint32), 0

    def _rest(self) -> None:
        """Waits until there was no text for IDLE seconds, then forgets and returns the memory to the system."""
        while True:
            time.sleep(IDLE / 4)
            with self.lock:
                if time.monotonic() - self.used > IDLE:
                    self.forget()
                    self.watched = False
                    break
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    def _learn(self, chunks: set[bytes]) -> None:
        cut = {}
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            cut[chunk] = _PARTS.findall(text.lower()) if _PLAIN.fullmatch(text) else text
        new = list({p for parts in cut.values() if type(parts) is list for p in parts}.difference(self.parts))
        for at in range(0, len(new), 1000):  # a part becomes one word of the vocabulary's: its last token says so
            some = new[at : at + 1000]
            ids = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            stops = (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1).tolist()
            if len(stops) != len(some):
                raise ValueError("the vocabulary does not end words as packing expects")
            self.parts |= {p: array("I", ids[a:b]) for p, a, b in zip(some, [0, *stops], stops)}
        starts, sizes, pool, first = [], [], array("I"), self.pool.size
        for number, (chunk, parts) in enumerate(cut.items(), self.starts.size):
            self.index[chunk] = number
            self.bytes += len(chunk)
            starts.append(first + len(pool))
            if type(parts) is list:
                for p in parts:
                    pool += self.parts[p]
            else:
                pool.extend(self.tokenizer.encode(parts, add_special_tokens=False).ids)
            sizes.append(first + len(pool) - starts[-1])
        for of, new in ((self.starts, starts), (self.lengths, sizes), (self.pool, pool)):
            of.extend(new)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        with self.lock:
            if not self.watched:
                self.watched = True
                threading.Thread(target=self._rest, daemon=True).start()
            try:
                return self._encode(texts)
            finally:
                self.used = time.monotonic()

    def _encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.index) > REMEMBERED or self.bytes > REMEMBERED_BYTES or self.pool.size > REMEMBERED_IDS:
            self.forget()
        # a special token's own string stays as it is written: lower-casing could make one
        found = [(t if b"<|" in t else t.translate(LOWER)).split() if t else [] for t in texts]
        flat = [c for f in found for c in f]
        get = self.index.get
        known = list(map(get, flat))
        if None in known:
            self._learn({c for c, k in zip(flat, known) if k is None})
            known = [get(c) if k is None else k for c, k in zip(flat, known)]
        at = np.array(known, np.int64)
        starts, pool = self.starts.values, self.pool.values
        size = self.lengths.values[at]
        ends = np.cumsum(size)
        ids = pool[np.repeat(starts[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[np.cumsum([0, *map(len, found)])]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class Growing:
    """A numpy array that grows at its end, by doubling."""

    def __init__(self, kind):
        self.values, self.size = np.empty(1024, kind), 0

    def extend(self, more) -> None:
        end = self.size + len(more)
        if end > len(self.values):
            self.values = np.concatenate([self.values, np.empty(max(end, 2 * len(self.values)) - len(self.values), self.values.dtype)])
        self.values[self.size : end] = more
        self.size = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The piece lengths of n tokens, longest first. ``longest`` is a power of two."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, longest: int, keep: bool) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for at, end in groups(texts, 128, GROUP_BYTES):
            rows: list[tuple] = []
            for doc, ids in zip(docs[at:end], code.encode(texts[at:end])):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                start = 0
                for n in lengths(len(ids), longest):
                    piece = ids[start : start + n]
                    rows.append((doc, start, n, zlib.crc32(piece.tobytes()), len(ids), piece))
                    start += n
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep:
                columns.append(pa.array([r[5].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, path: str | None = None, longest: int = LONGEST, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset, bucket), one row per piece and sequence.

    A null or empty text is one piece of one id. Rows that repeat a doc_id are packed each. ``bucket`` is the binary
    logarithm of the length; within a partition the longest come first and pieces of one length are consecutive.
    sequence_id is unique over all buckets, and stable as long as the input's partitions are.
    """
    path = path or default_vocabulary()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = texts.mapInArrow(lambda it: _pieces(it, path, longest, keep_ids), schema)
    return cut.sortWithinPartitions(F.desc("length")).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """``pack``'s rows as Parquet below ``path``, a folder ``bucket=k`` for the pieces of 2 ** k tokens. Nothing is exchanged."""
    packed.write.partitionBy("bucket").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
