import random

import pytest

#: Names that operators use for columns of their own.
CLASHING = "fp _gone _gone_id _gone_hash gone lines line hash row id root sim raw words again left _lines _text _bad _hash _kept _found found score bucket doc at lead".split()
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()


def prose(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names clash with operators' own."""
    r = random.Random(3)
    long = "\n".join(prose(r, 60) for _ in range(60))
    rows = [(1, "Hello, World! again and again", 7), (2, None, 7), (3, "", 7), (4, long, 7), (5, "same words here", 7), (5, "same words here", 7), (None, "no number", 7), (6, "   \n\t ", 7), (7, "Ünïcödé \U0001f600 ß", None), (8, "x" * 5000, 7)]
    names = CLASHING
    return spark.createDataFrame([(a, b, "en", "src", len(b or ""), c, *["k"] * len(names)) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """Some hundred texts with exact and near copies, shared lines and personal data."""
    r = random.Random(5)
    texts = [prose(r, r.randint(1, 90)) for _ in range(120)]
    for k in range(40):
        words = r.choice(texts).split()
        for _ in range(k % 4):
            words[r.randrange(len(words))] = r.choice(SYLLABLES)
        texts.append(" ".join(words))
    texts += [texts[0]] * 3 + ["\n".join([texts[1], texts[2], texts[k]]) for k in range(3, 9)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
