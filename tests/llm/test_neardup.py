import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hornbeam.llm import neardup
from hornbeam.llm.common import connected_components
from hornbeam.llm.simhash import majority
from tests.llm.conftest import prose


def kept(rows):
    """Texts that stay, by all pairs of shingle sets."""
    sets = [set(neardup.shingles((t or "").encode()).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return sorted(k for k, (_, _) in enumerate(rows) if group[k] == k)


def test_stage_against_all_pairs(spark):
    r = random.Random(21)
    texts = [prose(r, 150) for _ in range(25)]
    rows = []
    for k, text in enumerate(texts):
        for copy in range(r.randint(1, 5)):
            words = text.split()
            for _ in range(r.choice((0, 1, 2, 3, 6))):
                words[r.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "two words"), (len(rows) + 3, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = sorted(x["doc_id"] for x in stage(spark, docs, "").collect())
    assert got == kept(rows) and len(got) < len(rows)


def test_rows_without_a_number(spark):
    r = random.Random(22)
    text, other = prose(r, 200), prose(r, 200)
    rows = [(None, text), (None, text + " end"), (None, other), (3, other + " end")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] or 0 for x in got) == [0, 3] and sum(x["text"].startswith(text) for x in got) == 1


def test_odd_inputs(odd, none):
    assert neardup.keep_one(none).count() == 0
    out = neardup.keep_one(odd)
    assert out.columns == odd.columns and {2, 5, 7} <= {x["doc_id"] for x in out.collect()}


def test_fingerprints_alone_link_what_is_within_four_bits(spark, monkeypatch):
    r = random.Random(23)
    rows = []
    for _ in range(12):
        words = prose(r, 300).split()
        for k in range(4):
            rows.append((len(rows), " ".join(words[: len(words) - k])))
    prints = [majority(neardup.shingles(t.encode())) for _, t in rows]
    # within a group of texts that only lose words at the end, linked by four bits
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    monkeypatch.setattr(neardup, "band_pairs", lambda each: each.select(neardup.F.col("key").alias("a"), neardup.F.col("key").alias("b")).limit(0))
    got = sorted(x["doc_id"] for x in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [k for k in range(len(rows)) if group[k] == k] and len(got) < len(rows)


def test_fingerprint_is_the_majority_of_the_set(spark):
    texts = [prose(random.Random(24), n) for n in (1, 5, 6, 90)]
    got = neardup.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc"]: x["fp"] for x in got} == {k: int(np.uint64(majority(neardup.shingles(t.encode()))).view(np.int64)) for k, t in enumerate(texts)}


@pytest.mark.parametrize("by", ["bands", "prints"])
def test_all_that_share_a_bucket_are_compared(spark, by):
    r = random.Random(25)
    rows = []
    for _ in range(7):
        text = prose(r, 80)
        rows += [(len(rows) + k, text + " end" * k) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # one bucket holds them all; else fingerprints are further apart than the radius
    number = F.col("doc")
    each = neardup.signatures(docs).withColumns({"bands": F.array(F.lit(1).cast("long")), "fp": F.xxhash64("doc")})
    if by == "prints":
        each = each.withColumns({"bands": F.array().cast("array<long>"), "fp": F.when(number < 16, F.expr("shiftleft(1L, cast(doc as int))")).otherwise(number)})
    found = neardup.links(each, docs, each.select("key", "doc", "hash", "size", "fp") if "size" in each.columns else each.select("key", "doc", "hash", "fp"))
    of = {x["key"]: x["doc"] for x in each.collect()}
    group = {}
    for x in connected_components(found).collect():
        group.setdefault(x["root"], set()).add(of[x["node"]])
    assert sorted(map(sorted, group.values())) == [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(7)]


def test_apart_is_all_pairs_of_unlike_labels(spark):
    r = random.Random(26)
    rows = [(bucket, key, r.choice([1, 1, 1, 2, 3]), r.choice([10, 11, 14])) for bucket in range(20) for key in r.sample(range(99), r.randint(1, 9))]
    got = [(x["a"], x["b"]) for x in neardup.apart(spark.createDataFrame(rows, "bucket long, key long, label long, size int")).collect()]
    of = lambda b: [x for x in rows if x[0] == b]
    want = {(x[1], y[1]) for b in range(20) if len(of(b)) > 2 for x in of(b) for y in of(b) if x[1] < y[1] and x[2] != y[2] and min(x[3], y[3]) >= 0.8 * max(x[3], y[3])}
    assert len(got) == len(set(got)) and set(got) == want
