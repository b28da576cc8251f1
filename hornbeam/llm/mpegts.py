"""MPEG transport streams as a media column: write payloads into streams, read streams back.

A stream has 188-byte packets: a program association table, a program map table, and one elementary stream whose
access units travel in PES packets with time stamps. Tables come again before every random-access unit. Reading
follows the tables (their checksums are checked), checks each stream's continuity counters, drops repeated packets,
reassembles the elementary packets and gives each unit's time stamp and whether it is a random-access point.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, table

PACKET = 188
PROGRAM, PMT_PID, STREAM_PID = 1, 0x1000, 0x0100
#: Private data in PES packets.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
BLOCK = 576
UNIT = 56 * BLOCK
#: Of the 90 kHz clock: 25 units a second, a random-access point every 8 units.
STEP, RANDOM_ACCESS = 3600, 8


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc_mpeg(data: bytes) -> int:
    """Of a section; zero over a section with its checksum."""
    c, of = 0xFFFFFFFF, _crc_table()
    for byte in data:
        c = (c << 8 & 0xFFFFFFFF) ^ of[c >> 24 ^ byte]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return pat, pmt


def _table_packet(pid: int, counter: int, section: bytes) -> np.ndarray:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8).reshape(1, PACKET)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])


def _unit_packets(pes: bytes, counter: int, pts: int, entry: bool) -> np.ndarray:
    first = PACKET - 12 if entry else PACKET - 4
    n = 1 + max(0, -(-(len(pes) - first) // 184))
    out = np.full((n, PACKET), 255, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    body = np.frombuffer(pes, np.uint8)
    room, last = first, body
    if n > 1:
        out[0, PACKET - first :] = body[:first]
        middle = first + 184 * (n - 2)
        out[1:-1, 4:] = body[first:middle].reshape(-1, 184)
        room, last = 184, body[middle:]
    pad = room - len(last)
    out[-1, PACKET - len(last) :] = last
    if pad and not (entry and n == 1):
        out[-1, 3] |= 0x20
        out[-1, 4] = pad - 1
        if pad > 1:
            out[-1, 5] = 0
    if entry:
        out[0, 3] |= 0x20
        out[0, 4] = 7 + (pad if n == 1 else 0)
        out[0, 5] = 0x50
        out[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    return out


def mux(payload: bytes) -> bytes:
    """A stream of the payload's units of UNIT bytes; an empty payload is one empty unit."""
    parts, counter = [], 0
    pat, pmt = _tables()
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        data, pts, entry = payload[at : at + UNIT], k * STEP & (1 << 33) - 1, k % RANDOM_ACCESS == 0
        if entry:
            parts += [_table_packet(0, k // RANDOM_ACCESS, pat), _table_packet(PMT_PID, k // RANDOM_ACCESS, pmt)]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        packets = _unit_packets(pes, counter, pts, entry)
        counter += len(packets)
        parts.append(packets)
    return np.concatenate(parts).tobytes()


@dataclass
class Elementary:
    """One elementary stream. starts: where each unit begins in the payload; pts -1: the unit has none."""

    program: int
    pid: int
    kind: int
    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    entry: list[bool] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    gaps: int = 0
    repeats: int = 0


def _sections(packets: np.ndarray, start: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    """Sections with a right checksum, also those over several packets."""
    buffer = None
    for row, at, unit in zip(packets, start.tolist(), first.tolist()):
        data = row[at:].tobytes()
        if unit:
            tail, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            buffer = None if buffer is None else buffer + tail
            if buffer and len(buffer) >= 3 and len(buffer) >= 3 + (int.from_bytes(buffer[1:3], "big") & 0xFFF):
                data = buffer + data
            buffer = b""
        if buffer is None:
            continue
        buffer += data
        while len(buffer) >= 3 and buffer[0] != 0xFF and len(buffer) >= (size := 3 + (int.from_bytes(buffer[1:3], "big") & 0xFFF)):
            if crc_mpeg(buffer[:size]) == 0:
                yield buffer[:size]
            buffer = buffer[size:]


def demux(stream: bytes) -> tuple[list[Elementary], int]:
    """The elementary streams that the tables name, and how many packets were unusable.

    Packets without a sync byte, marked as broken, or with an impossible adaptation field are skipped; a packet that
    repeats the one before it is dropped; a jump of the continuity counter counts as a gap. Bytes of a unit before
    the first unit start are dropped. A stream without tables has no elementary streams.
    """
    n = len(stream) // PACKET
    p = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    field_ = (p[:, 3] & 0x20) > 0
    start = 4 + np.where(field_, p[:, 4].astype(np.int64) + 1, 0)
    usable = (p[:, 0] == 0x47) & (p[:, 1] & 0x80 == 0) & (start <= PACKET)
    bad = int(n - usable.sum()) + (len(stream) % PACKET > 0)
    p, start, field_ = p[usable], start[usable], field_[usable]
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    loaded = (p[:, 3] & 0x10) > 0
    first = (p[:, 1] & 0x40) > 0

    def of(which: int) -> np.ndarray:
        return np.flatnonzero((pid == which) & loaded)

    maps: dict[int, int] = {}
    for s in _sections(p[k := of(0)], start[k], first[k]):
        if s[0] == 0:
            maps |= {int.from_bytes(s[a + 2 : a + 4], "big") & 0x1FFF: int.from_bytes(s[a : a + 2], "big") for a in range(8, len(s) - 4, 4)}
    out: dict[int, Elementary] = {}
    for which, program in maps.items():
        if not program:
            continue  # the network's own table
        for s in _sections(p[k := of(which)], start[k], first[k]):
            at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while s[0] == 2 and at < len(s) - 4:
                es = int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF
                out.setdefault(es, Elementary(program, es, s[at]))
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    for es in out.values():
        k = of(es.pid)
        counter = p[k, 3] & 15
        step = (counter[1:].astype(np.int64) - counter[:-1]) & 15
        again = np.append(False, (step == 0) & (p[k[1:]] == p[k[:-1]]).all(axis=1))
        es.repeats = int(again.sum())
        k = k[~again]
        step = np.diff(p[k, 3].astype(np.int64) & 15) & 15
        told = field_[k] & (start[k] > 5) & (p[k, 5] & 0x80 > 0)  # a discontinuity that is announced is none
        es.gaps = int(((step != 1) & ~told[1:]).sum())
        body = p[k][np.arange(PACKET) >= start[k][:, None]].tobytes()
        ends = np.cumsum(PACKET - start[k])
        units = np.flatnonzero(first[k])
        begin = (ends - (PACKET - start[k]))[units].tolist() + [int(ends[-1]) if len(ends) else 0]
        random = (field_[k] & (start[k] > 5) & (p[k, 5] & 0x40 > 0))[units].tolist()
        parts, size = [], 0
        for a, b, entry in zip(begin, begin[1:], random):
            pes = body[a:b]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                es.gaps += 1
                continue
            length = int.from_bytes(pes[4:6], "big")
            data = pes[9 + pes[8] : 6 + length if length else None]
            t = pes[9:14]
            es.pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if pes[7] & 0x80 else -1)
            es.entry.append(entry)
            es.starts.append(size)
            parts.append(data)
            size += len(data)
        es.payload = b"".join(parts)
    return list(out.values()), bad


def padded(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of BLOCK."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b"\xff")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_ = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for at, end in groups(all_, 256):
            part, texts = batch.slice(at, end - at), all_[at:end]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def write_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a stream. Null text: empty. One row per input row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<bigint>, random_access array<boolean>"
_READ_PA = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for doc, n, media in zip(*(c.to_pylist() for c in part.columns)):
                streams, bad = demux(media or b"")
                es = streams[0] if streams else Elementary(0, 0, 0)
                counts = np.bincount(np.frombuffer(es.payload, np.uint8), minlength=256)
                share = counts[counts > 0] / max(1, len(es.payload))
                feature = (
                    f"program={es.program};pid={es.pid};type={es.kind};packets={len(media or b'') // PACKET};bad={bad};gaps={es.gaps};repeats={es.repeats};units={len(es.pts)};"
                    f"entries={sum(es.entry)};pts={es.pts[0] if es.pts else -1}..{es.pts[-1] if es.pts else -1};entropy={-(share * np.log2(share)).sum() + 0.0:.6f}"
                )
                rows.append((doc, n, len(es.payload), hashlib.sha256(es.payload).hexdigest(), zlib.crc32(es.payload[-32:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), feature, es.pts, es.entry))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_READ_PA)], [c.split()[0] for c in _READ.split(", ")])


def read_media(media: DataFrame) -> DataFrame:
    """What the streams hold, by (doc_id, n_bytes, media). A null, empty or damaged stream gives what is left of it."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(write_media(table(spark, sf_dir, "documents")))
