import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hornbeam.llm import decontam, linededup, packing, simhash, toxicity
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    home = tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    items = [(k, prose(r, 14)) for k in range(5)]
    shared = prose(r, 55)
    for k in range(400):
        lines = [prose(r, r.randint(15, 40)) for _ in range(3)]
        toxic = k % 5 == 1
        if toxic:
            lines[1] += " vilebird dungheap snotface vilebird"
        if k % 7 == 2:
            lines.append(shared)
        if k % 11 == 3:
            lines[0] += " " + items[k % 5][1]
        docs.append((k, "\n".join(lines), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    docs += [(1000 + k, docs[k][1], "en", "s", 0) for k in (0, 4, 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home), docs, items, shared


def test_stages(spark, folder):
    home, docs, items, shared = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    at = {"documents": spark.read.parquet(f"{home}/documents.parquet")}
    now = at["documents"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, home)
        if name != "packing":
            assert out.columns == now.columns
        at[name] = now = spark.createDataFrame(out.collect(), out.schema)
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in at.items()}
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(at["documents"], spark.read.parquet(f"{home}/labels.parquet")).collect()}
    assert ids["toxicity"] == {k for k, p in scored.items() if not p} and len(ids["documents"]) - len(ids["toxicity"]) > 50
    assert ids["line_dedup"] == ids["toxicity"]
    texts = {r["doc_id"]: r["text"] for r in at["line_dedup"].collect()}
    assert sum(shared in t for t in texts.values()) == 1 and texts[1000] == ""
    assert ids["near_dedup"] == {r["doc_id"] for r in simhash.near_groups(at["line_dedup"]).filter("doc_id = component_id").collect()}
    index = decontam.Index([(str(k), t.encode()) for k, t in items])
    found = {k: decontam.words(texts[k].encode()) for k in ids["near_dedup"]}
    assert ids["decontamination"] == {k for k, ws in found.items() if not (ws and index.find(ws)[0])} < ids["near_dedup"]
    assert ids["packing"] == ids["decontamination"]
    assert linededup.dedup_lines(at["line_dedup"]).filter(F.col("text") != "").count() == sum(t != "" for t in texts.values())


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert rows and all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) for r in rows)
    assert packing.END in rows[0]["ids"] or any(packing.END in r["ids"] for r in rows)
