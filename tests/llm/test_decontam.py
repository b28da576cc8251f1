import hashlib
import random
import re

from hornbeam.llm import decontam


def brute(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, met = words(text), set(), set()
    for name, item in items:
        item = words(item)
        n = min(10, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for p in range(len(doc) - n + 1 if n else 0):
            if tuple(doc[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                met.add(str(name))
    return len(doc), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([1, 2, 4, 7, 9, 10, 11, 25]))) for k in range(12)] + [(50, ""), (51, None), (52, "Ärger, ÄRGER! ärger-ärger")]
    docs = []
    for k in range(60):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            item = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(item) - 8))
            parts += [" ".join(item[a : a + r.randint(6, 14)]).upper(), text(r.randint(0, 9))]
        docs.append((k, ". ".join(parts)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = {k: brute(t, items) for k, t in docs}
    for block in (1 << 20, 60):  # one block, and several
        got = {r["doc_id"]: tuple(r["found"])[:5] for r in decontam.mark(df, bench, block_bytes=block).collect()}
        assert got == expected
    assert 5 < sum(e[4] for e in expected.values()) < 60
    assert {r["doc_id"] for r in decontam.drop_contaminated(df, bench).collect()} == {k for k, e in expected.items() if not e[4]}


def test_odd_inputs(spark, odd, none):
    bench = spark.createDataFrame([(1, "hello world"), (1, "no such thing at all"), (None, "same words here")], "item_id long, text string")
    out = decontam.drop_contaminated(odd, bench)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 2, 3, 4, 6, 7, 8]
    assert decontam.mark(none, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
