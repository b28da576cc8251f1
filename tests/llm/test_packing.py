import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hornbeam.llm import packing

PATH = packing.default_vocabulary()
TOKENIZER = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("aAbéÉ. ,'<|>ſİΣß12́\x1c\xa0\n")), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert packing.encoder(PATH).encode([text.encode()])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_cases():
    for text in ("don't we'll 's", "<|endoftext|> <|ENDOFTEXT|>", "a.b, c., ...", "É.É É,", "x" * 3000):
        assert packing.encoder(PATH).encode([text.encode()])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_an_idle_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "IDLE", 0.2)
    code, texts = packing.Encoder(PATH), [b"some words, and others", None, b"words"]
    for _ in range(2):
        ids = [x.tolist() for x in code.encode(texts)]
        assert ids == [TOKENIZER.encode((t or b"").decode(), add_special_tokens=False).ids for t in texts] and code.index and code.parts
        deadline = time.monotonic() + 10
        while code.index and time.monotonic() < deadline:
            time.sleep(0.05)
        assert not code.index and not code.parts and not code.pool.size


def test_pieces(odd, none):
    rows = packing.pack(odd).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by = {}
    for r in rows:
        assert r["length"] == 1 << r["bucket"] and r["length"] <= 4096 and r["offset"] == 0 and len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["doc_id"], []).append(r)
    for d in odd.filter("doc_id <> 5").collect():
        pieces = sorted(by[d["doc_id"]], key=lambda r: r["start"])
        ids = [i for p in pieces for i in p["ids"]]
        assert ids == TOKENIZER.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
        assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    assert sum(r["doc_id"] == 5 and r["start"] == 0 for r in rows) == 2
    assert packing.pack(none).count() == 0


def test_lengths():
    for n in (1, 2, 4095, 4096, 4097, 3 * 4096 + 5):
        got = packing.lengths(n)
        assert sum(got) == n and all(g & g - 1 == 0 for g in got) and len(got) == n // 4096 + (n % 4096).bit_count()


def test_buckets(spark, odd, tmp_path):
    packed = packing.pack(odd)
    for part in packed.select("bucket", "sequence_id").rdd.glom().collect():
        assert [r["bucket"] for r in part] == sorted((r["bucket"] for r in part), reverse=True)
    packing.write_buckets(packed, str(tmp_path / "packed"))
    folders = {f.name for f in (tmp_path / "packed").iterdir() if f.is_dir()}
    assert folders == {f"bucket={r['bucket']}" for r in packed.collect()}
    assert spark.read.parquet(str(tmp_path / "packed")).count() == packed.count()


def test_a_worker_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 50)
    code = packing.Encoder(PATH)
    for k in range(40):
        text = " ".join(f"word{k}x{j}" for j in range(9))
        assert code.encode([text.encode(), None])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert code.bytes < 500
