import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from hornbeam.llm import mpegts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.integers(0, 4))
def test_round_trip(head, units):
    payload = head + b"\x47\x00\x00\x01" * (units * 8064)
    (es,), bad = mpegts.demux(mpegts.mux(payload))
    assert es.payload == payload and (bad, es.gaps, es.repeats) == (0, 0, 0)
    assert es.pts == [k * mpegts.STEP for k in range(len(es.pts))] and es.entry == [k % 8 == 0 for k in range(len(es.pts))]
    assert len(es.pts) == max(1, -(-len(payload) // mpegts.UNIT))


def test_every_length():
    for n in range(0, 600):
        (es,), _ = mpegts.demux(mpegts.mux(b"\xff" * n))
        assert es.payload == b"\xff" * n


def test_packets_are_well_formed():
    stream = mpegts.mux(b"a" * 300_000)
    assert len(stream) % 188 == 0 and all(stream[k] == 0x47 for k in range(0, len(stream), 188))
    assert mpegts.crc_mpeg(b"123456789") == 0x0376E6E7


def test_damage():
    packets = [mpegts.mux(b"abc" * 40_000)[k : k + 188] for k in range(0, 188 * 60, 188)]
    (es,), bad = mpegts.demux(b"".join(packets[:10] + packets[11:]))
    assert (es.gaps, bad) == (1, 0)
    (es,), bad = mpegts.demux(b"".join(packets[:10] + packets[9:]))
    assert (es.gaps, es.repeats) == (0, 1)
    (es,), bad = mpegts.demux(b"".join(packets[:10]) + b"\0" * 188 + b"".join(packets[11:]) + b"x")
    assert (es.gaps, bad) == (1, 2)
    broken = packets[0][:20] + b"\x01" + packets[0][21:]
    assert mpegts.demux(broken)[0] == [] and mpegts.demux(b"") == ([], 0)


def test_columns(odd, none):
    rows = {(r["doc_id"]): r for r in mpegts.read_media(mpegts.write_media(odd)).collect()}
    for d in odd.collect():
        text = (d["text"] or "").encode()
        payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > r["payload_bytes"] and r["media_sha256"] == hashlib.sha256(mpegts.mux(payload)).hexdigest()
    assert mpegts.read_media(mpegts.write_media(none)).count() == 0
