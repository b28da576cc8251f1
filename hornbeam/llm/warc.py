"""WARC archives and their index.

Pages are written as gzip members of WARC/1.1 archives: a payload that an earlier page (by page_id) has already is a
``revisit`` of that page, any other a ``response``. Archives live in the cluster's shared checkpoint folder. Reading
them back gives one locally sorted run of captures per archive. The index is an external merge: a range exchange deals
the captures by (URL key, timestamp, page), and each range merges its part of the runs through a loser tree, so the
partitions in order are one globally ordered capture history. The range key has the page in it, so a URL captured any
number of times is split too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: Bytes of an archive, about.
ARCHIVE_BYTES = 4 << 20
#: Bytes that reading decompresses at a time; what is left of them after a member is all that is copied.
SLICE = 1 << 14
#: Pages have no capture time; page 0 is taken to be captured then, each further one a second later.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then port and path: captures of a site and its subdomains sort together."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"-){(url or '').strip().lower()}"
    labels = host.split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    at = ",".join(reversed(labels)) or "-"
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{at}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def captured(page: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page or 0) % (1 << 31))


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record as a gzip member; refers_to: the page whose payload it repeats."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": captured(page).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    block = head + (payload if refers_to is None else b"")
    lines = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 3, mtime=0)


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields (lower-case names) and block of each member. A cut-off last member is an error."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof and end < len(archive):
            parts.append(member.decompress(view[end : end + SLICE]))
            end = min(end + SLICE, len(archive))
        if not member.eof:
            raise ValueError(f"the member at {at} is cut off")
        data, size = b"".join(parts), end - at - len(member.unused_data)
        lines, _, rest = data.partition(b"\r\n\r\n")
        version, *rows = lines.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"the member at {at} is not a record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows)}
        yield at, size, fields, rest[: int(fields["content-length"])]
        at += size


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"crawl-{task:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "warc"])

    for batch in batches:
        for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
            parts.append(record(page, url, (html or "").encode(), first))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
                number, parts, size = number + 1, [], 0
    if parts:
        yield flush()


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, warc): the pages' records in archives, kept in the shared folder.

    Null html is an empty payload. Payloads are equal if their SHA-1 and lengths are. Of rows that repeat a page_id
    and a payload none revisits the other. A page without page_id revisits any that has one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.sha1("html")).withColumn("size", F.octet_length("html"))
    first = rows.groupBy("sum", "size").agg(F.min("page_id").alias("first"))
    told = rows.join(first, ["sum", "size"]).select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    return settle(told.mapInArrow(_archives, "archive string, warc binary"))


_CAPTURE = "url_key string, timestamp string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long, at long"
_NAMES = [c.split()[0] for c in _CAPTURE.split(", ")]
_KINDS = [pa.int64() if c.split()[1] == "long" else pa.string() for c in _CAPTURE.split(", ")]


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and len(urn) > 11 else None


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive's captures, sorted; at: the place in that run."""
    for batch in batches:
        for name, warc in zip(*(c.to_pylist() for c in batch.columns)):
            rows = []
            for at, size, head, block in records(warc):
                http, _, body = block.partition(b"\r\n\r\n")
                total = int(next(line for line in http.decode().split("\r\n") if line.lower().startswith("content-length:")).partition(":")[2])
                said = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(body) != total or digest(body) != said):
                    raise ValueError(f"{name} at {at}: the payload is not what its record says")
                when = "".join(c for c in head["warc-date"] if c.isdigit())
                rows.append((url_key(head["warc-target-uri"]), when, _page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], total, said, _page(head.get("warc-refers-to")), name, at, size))
            rows = [(*r, k) for k, r in enumerate(sorted(rows, key=_order))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], _NAMES)


def read_runs(archives: DataFrame) -> DataFrame:
    """The captures of (archive, warc) rows, one sorted run per archive. Damaged archives are an error."""
    return archives.select("archive", "warc").mapInArrow(_runs, _CAPTURE)


def loser_tree(runs: list[Iterator[tuple]], key) -> Iterator[tuple]:
    """The sorted runs as one sorted sequence, with one comparison for each level of the tree and row."""
    n = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]
    keys = [key(h) if h is not None else None for h in heads]

    def before(a: int, b: int) -> bool:
        """Whether run a's head goes first; a run without rows loses, of equal heads the lower run wins."""
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return keys[a] < keys[b] or keys[a] == keys[b] and a < b

    losers = [0] * n

    def build(node: int) -> int:
        if node >= n:
            return node - n
        a, b = build(2 * node), build(2 * node + 1)
        winner, losers[node] = (a, b) if before(a, b) else (b, a)
        return winner

    winner = build(1) if n else -1
    while n and heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        keys[winner] = key(heads[winner]) if heads[winner] is not None else None
        node = (winner + n) // 2
        while node:
            if before(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def _run(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run by their place in it; only some of them are Python values at a time."""
    rows = pa.Table.from_batches(parts)
    rows = rows.take(np.argsort(rows.column("at").to_numpy(), kind="stable"))  # an exchange may deliver its blocks in any order
    for batch in rows.to_batches(max_chunksize=256):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range's captures, its parts of the runs merged; they stay in columns until their turn comes."""
    runs: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        names = batch.column(8).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                runs.setdefault(names[a], []).append(batch.slice(a, b - a))
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(_KINDS[:-1])], _NAMES[:-1])

    for row in loser_tree([_run(runs[name]) for name in sorted(runs)], _order):
        out.append(row)
        if len(out) == 4096:
            yield flush()
            out = []
    if out:
        yield flush()


def merge_index(captures: DataFrame) -> DataFrame:
    """The capture history: rows of ``read_runs`` in global order of (url_key, timestamp, page_id) over the partitions.

    Captures without page_id go before those with one of the same URL key and timestamp.
    """
    dealt = captures.repartitionByRange("url_key", "timestamp", "page_id", "archive", "offset")
    return dealt.mapInArrow(_merge, _CAPTURE.removesuffix(", at long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = merge_index(settle(read_runs(write_archives(table(spark, sf_dir, "pages")))))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY s, strlen(html)) AS first,
             array_to_string(list_transform(string_split(s, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
