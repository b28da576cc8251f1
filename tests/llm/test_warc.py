import base64
import hashlib
import random
import time

import pytest

from hornbeam.llm import warc


def test_archives_and_history(spark):
    r = random.Random(2)
    html = [None, "", "<p>a</p>", "<p>é</p>", "x" * 3000]
    pages = [(k, f"http://{'www.' * (k % 2)}h{r.randint(0, 3)}.example.com/p{r.randint(0, 4)}?q=\r\n{k % 3}" if k % 7 else None, r.choice(html)) for k in range(80)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    runs = warc.read_runs(warc.write_archives(df))
    history = warc.merge_index(runs)
    parts = history.rdd.glom().collect()
    rows = [x for p in parts for x in p]
    keys = [(x["url_key"], x["timestamp"], x["page_id"]) for x in rows]
    assert keys == sorted(keys) and len(rows) == len(pages)
    first = {}
    for k, _, h in pages:
        first.setdefault(h or "", k)
    for x in rows:
        payload = (pages[x["page_id"]][2] or "").encode()
        assert x["payload_bytes"] == len(payload) and x["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        owner = first[payload.decode()]
        assert (x["record_type"], x["refers_to"]) == (("response", None) if owner == x["page_id"] else ("revisit", owner))


def test_records_round_trip():
    archive = b"".join(warc.record(k, "http://a.example/ü", f"<p>{k}</p>".encode(), None if k < 2 else 0) for k in range(4))
    got = list(warc.records(archive))
    assert [head["warc-type"] for _, _, head, _ in got] == ["response", "response", "revisit", "revisit"]
    assert got[1][3].endswith(b"\r\n\r\n<p>1</p>") and sum(size for _, size, _, _ in got) == len(archive)
    with pytest.raises(ValueError):
        list(warc.records(archive[:-3]))


def test_archives_are_read_in_linear_time():
    began = time.time()
    archive = b"".join(warc.record(k, "http://a.example/", b"<p>x</p>" * (k % 50), None) for k in range(40_000))
    assert sum(1 for _ in warc.records(archive)) == 40_000 and time.time() - began < 60
    big = warc.record(0, "u", random.Random(1).randbytes(300_000), None)
    assert [size for _, size, _, _ in warc.records(big + big)] == [len(big)] * 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8])
def test_loser_tree(n):
    r = random.Random(n)
    runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 9))) for _ in range(n)]
    got = list(warc.loser_tree([iter([(v, k) for v in run]) for k, run in enumerate(runs)], lambda x: x[0]))
    assert got == sorted(((v, k) for k, run in enumerate(runs) for v in run))


def test_url_keys():
    assert warc.url_key("HTTP://www.B.example.com:8080/x?y=1") == "com,example,b:8080)/x?y=1"
    assert warc.url_key("https://b.example.com:443") == "com,example,b)/" and warc.url_key(None) == "-)/"
    assert warc.url_key("http://[bad") == "-)http://[bad"


def test_odd_inputs(spark):
    df = spark.createDataFrame([(5, "u", "same", 1), (5, "u", "same", 1), (None, "u", "same", 2), (3, None, None, 3), (9, "v", "", 4)], "page_id long, url string, html string, digest int")
    rows = warc.merge_index(warc.read_runs(warc.write_archives(df))).collect()
    got = sorted((x["page_id"] or 0, x["record_type"], x["refers_to"] or 0) for x in rows)
    assert got == [(0, "revisit", 5), (3, "response", 0), (5, "response", 0), (5, "response", 0), (9, "revisit", 3)]
    assert warc.merge_index(warc.read_runs(warc.write_archives(df.limit(0)))).count() == 0
