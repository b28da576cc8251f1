import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hornbeam.llm import lm


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows):
    counts = Counter(t for doc, text in rows if not held(doc) for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    return total, [(held(doc), len(ts := tokens(text)), sum(counts[t] > 0 for t in ts), sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in ts)) for doc, text in rows]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    pairs = {f"a{k}": [f"b{j}" for j in range(k, k + 3)] for k in range(20)}

    def text():
        out = []
        for _ in range(r.randint(0, 60)):
            a = r.choice(list(pairs))
            out += [a.upper(), r.choice(pairs[a])] if r.random() < 0.9 else [f"rare{r.randint(0, 300)}"]
        return " \t".join(out)

    return [(k, text()) for k in range(300)] + [(300, None), (301, "")]


@pytest.mark.parametrize("sent", [5, 100_000])
def test_counts_and_base(spark, rows, sent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total, expected = brute(rows)
    got = {x["doc_id"]: x for x in lm.score(df, classes=32, sent=sent).collect()}
    for (doc, _), (h, n, known, base) in zip(rows, expected):
        x = got[doc]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (h, n, known, total)
        assert x["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(x["score"])


def test_the_model_beats_the_base_on_held_out_texts(spark, rows):
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), classes=64).filter("held_out").collect()
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got)


def test_probabilities_sum_to_one():
    noise = np.random.default_rng(0).dirichlet(np.ones(30))
    model = lm.LogBilinear(noise)
    model.target *= 5
    first, second, total = model.tables()
    logs = first[:, None, :] + second[None, :, :] - total[:, :, None]
    assert np.allclose(np.exp(logs.astype(float)).sum(axis=2), 1, atol=1e-4)
    vocabulary = lm.Vocabulary([(b"x", 9), (b"y", 5), (b"z", 1)], 4, 30, 9, 4)
    share = sum(10 ** (vocabulary.base[k] - vocabulary.other) for k in range(3) if vocabulary.classes[k] == lm.OTHER)
    rest = (30 - 4 - 9 - 5 - 1 + lm.SMOOTH * (9 + 1 - 4)) / vocabulary.denominator / 10**vocabulary.other
    assert share + rest == pytest.approx(1)


def test_odd_inputs(odd, none):
    assert lm.score(none).count() == 0
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(x["score"]) and x["n_tokens"] >= 1 for x in got)
