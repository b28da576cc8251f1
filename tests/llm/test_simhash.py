import re

import xxhash

from hornbeam.llm import simhash


def brute(texts):
    """The fingerprint by its definition, one bit after the other."""
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)))
    return out


def groups(prints, radius):
    """Smallest index reachable, by plain search over all pairs."""
    out = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                low = min(out[i], out[j])
                if (prints[i] ^ prints[j]).bit_count() <= radius and (out[i], out[j]) != (low, low):
                    out[i] = out[j] = low
                    changed = True
    return out


def test_against_brute_force(spark, corpus):
    rows = sorted(corpus.collect(), key=lambda r: r["doc_id"])
    prints = brute([r["text"] for r in rows])
    expected = {r["doc_id"]: (p, rows[g]["doc_id"]) for r, p, g in zip(rows, prints, groups(prints, 4))}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_groups(corpus).collect()}
    assert got == expected
    assert len({g for _, g in got.values()}) < len(got)
    kept = {r["doc_id"] for r in simhash.keep_one(corpus).collect()}
    assert kept == {g for _, g in got.values()}


def test_tiles_lose_no_link(spark):
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << k) - 1 << 3 for k in range(0, 40)] + [base ^ 1 << k for k in range(64)]
    signed = [p - (1 << 64) if p >> 63 else p for p in {p & (1 << 64) - 1 for p in prints}]
    from hornbeam.llm.common import connected_components

    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["root"] for r in connected_components(simhash.links(df)).collect()}
    assert len(roots) == 1


def test_odd_inputs(odd, none):
    assert simhash.near_groups(none).count() == 0
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_groups(odd).collect()}
    assert got[2, 0] == got[3, 0] == got[6, 0] == 2
    assert simhash.near_groups(odd).count() == odd.count()
    assert simhash.keep_one(odd).columns == odd.columns


def test_components(spark):
    from hornbeam.llm.common import connected_components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
