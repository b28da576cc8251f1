import random
import zlib

from hornbeam.llm import toxicity
from tests.llm.conftest import prose

BAD = ["vilebird", "dungheap", "snotface"]


def made(spark, n):
    r = random.Random(8)
    rows = []
    for k in range(n):
        words, toxic = prose(r, r.randint(20, 120)).split(), k % 4 == 0
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", ".", "!"]))
        rows.append((k, " ".join(words), int(toxic)))
    return spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], 1, x[2]) for x in rows], "doc_id long, quality int, toxic int"), rows


def test_held_out_texts(spark):
    docs, labels, rows = made(spark, 800)
    got = {x["doc_id"]: x for x in toxicity.score(docs, labels).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= got[k]["score"] <= 1 and got[k]["predicted"] == (got[k]["score"] >= 0.5) for k, _, _ in rows)
    held = [(x, got[k]["predicted"]) for k, _, x in rows if got[k]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    kept = {x["doc_id"] for x in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {k for k, x in got.items() if not x["predicted"]}


def test_held_out_labels_are_never_read(spark):
    docs, labels, rows = made(spark, 200)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert sorted(map(tuple, toxicity.score(docs, labels).collect())) == sorted(map(tuple, toxicity.score(docs, flipped).collect()))


def test_odd_inputs(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1), (99, 1), (1, 1)], "doc_id long, toxic int")
    for docs, marks in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        got = toxicity.score(docs, marks).collect()
        assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got)
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_rows_without_a_number_are_decided_on_each(spark):
    docs, labels, rows = made(spark, 400)
    more = [(None, "vilebird dungheap snotface " * 5), (None, "the plain words of another text")]
    kept = toxicity.drop_toxic(docs.union(spark.createDataFrame(more, docs.schema)), labels)
    assert [x["text"] for x in kept.filter("doc_id is null").collect()] == [more[1][1]]


def test_repeated_labels_and_documents_count_once(spark):
    docs, labels, rows = made(spark, 300)
    once = sorted(map(tuple, toxicity.score(docs, labels).collect()))
    one = rows[1][0] if zlib.crc32(str(rows[1][0]).encode()) % 5 else rows[2][0]
    again = toxicity.score(docs, labels.union(labels.filter(f"doc_id = {one}")).union(labels.filter(f"doc_id = {one}")))
    assert sorted(map(tuple, again.collect())) == once
    more = toxicity.score(docs.union(docs.filter(f"doc_id = {one}")), labels).distinct()
    assert sorted(map(tuple, more.collect())) == once
