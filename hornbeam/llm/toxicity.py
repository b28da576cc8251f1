"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary texts, share their lowest level: the
continuation counts of both classes together. An expression too rare to be counted by class therefore has (almost)
the same probability under either model and says nothing. A text's evidence is the difference of the two
length-normalised log-likelihoods, over the whole text and over its most toxic run of ``RUN`` words (so that a long
text can't dilute an insult). A logistic curve, fitted on labelled texts that the models did not count, turns the
evidence into a score.

Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0; nothing but the text enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, free, settle, table

#: Bound of the sample that the classifier is fitted on: about so many labelled documents of each class, one text of
#: each, none longer than SAMPLE_BYTES. Half of them are counted, half fit the curve.
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 1 << 16
#: In how many texts of the sample an expression must be to have counts by class; rarer ones have only their shared
#: count. The one with the least loss on the texts that fit the curve is taken.
LEAST_COUNTS = (5, 10, 15, 20, 30, 40, 60, 90)
DISCOUNT = 0.75
RUN = 2
#: What a word may end or begin with, beside letters and digits.
_EDGE = b".,;:!?\"'()[]{}<>*#%$&-_/\\"


def words(text: bytes) -> list[bytes]:
    return [w.strip(_EDGE) for w in text.translate(LOWER).split()]


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of a batch with their counts in toxic and ordinary texts; a is null for single words."""
    for batch in batches:
        grams: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            found = words(text or b"")
            grams[toxic].update((None, w) for w in set(found))
            grams[toxic].update(set(zip(found, found[1:])))
            grams[toxic][(None, b"")] += 1  # a text
        keys = list(grams[0].keys() | grams[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.binary())] + [pa.array([grams[c][k] for k in keys], pa.int64()) for c in (1, 0)], ["a", "b", "toxic", "plain"]
        )


class Model:
    """The two models as lookup tables of log-likelihood differences, toxic minus ordinary."""

    def __init__(self, unigrams: list[tuple[bytes, int, int, int]], bigrams: list[tuple[bytes, bytes, int, int]], rest: tuple[int, int, int], least: int):
        """unigrams: word, its texts by class, its distinct predecessors; rest: the same sums of the words that have no entry.

        Lowest level: distinct predecessors of both classes together. Words: texts of the class, discounted, backing off to
        it; the words without an entry, or in fewer than ``least`` texts, are one further word. Pairs: likewise, backing
        off to words.
        """
        rest = [r + sum(u[k + 1] for u in unigrams if u[1] + u[2] < least) for k, r in enumerate(rest)]
        unigrams = [u for u in unigrams if u[1] + u[2] >= least]
        bigrams = [p for p in bigrams if p[2] + p[3] >= least]
        self.ids = {w: i for i, (w, *_) in enumerate(unigrams)}
        v = len(unigrams)
        entries = np.array([u[1:] for u in unigrams] + [rest], float).reshape(v + 1, 3)
        counts, shared = entries[:, :2], entries[:, 2] + 1
        shared = shared / shared.sum()
        kept = np.maximum(counts - DISCOUNT, 0) / np.maximum(counts.sum(axis=0), 1)
        low = kept + (1 - kept.sum(axis=0)) * shared[:, None]
        low = np.maximum(low, 1e-300)
        self.single = np.log(low[:, 0]) - np.log(low[:, 1])
        pairs = [(self.ids[a], self.ids[b], x, y) for a, b, x, y in bigrams if a in self.ids and b in self.ids]
        first, second = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        number = np.array([p[2:] for p in pairs], float).reshape(-1, 2)
        context = np.maximum(counts, 1)
        for c in (0, 1):  # a pair is in a text once, its first word may be in several pairs
            context[:, c] = np.maximum(context[:, c], np.bincount(first, number[:, c], minlength=v + 1))
        high = np.maximum(number - DISCOUNT, 0) / context[first]
        weight = np.column_stack([1 - np.bincount(first, high[:, c], minlength=v + 1) for c in (0, 1)])
        weight = np.clip(weight, 1e-6, 1)
        self.rest = np.log(weight[:, 0]) - np.log(weight[:, 1])
        both = np.log(high + weight[first] * low[second])
        keys = first * (v + 1) + second
        order = np.argsort(keys)
        self.keys, self.pair = np.append(keys[order], np.iinfo(np.int64).max), np.append((both[:, 0] - both[:, 1])[order], 0)

    def evidence(self, text: bytes) -> tuple[float, float]:
        """Length-normalised difference over the whole text, and the largest over RUN words."""
        found = words(text)
        if not found:
            return 0.0, 0.0
        other = len(self.ids)
        get = self.ids.get
        ids = np.array([get(w, other) for w in found], np.int64)
        diff = self.single[ids]
        if len(ids) > 1:
            diff[1:] += self.rest[ids[:-1]]
            keys = ids[:-1] * (other + 1) + ids[1:]
            at = np.searchsorted(self.keys, keys)
            diff[1:] = np.where(self.keys[at] == keys, self.pair[at], diff[1:])
        sums = np.append(0, np.cumsum(diff))
        run = (sums[RUN:] - sums[:-RUN]).max() / RUN if len(diff) >= RUN else diff.mean()
        return float(diff.mean()), float(run)


def fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, list[float]]:
    """The loss and coefficients of ridge logistic regression by Newton steps; classes weighted so that ``share`` of the weight is toxic."""
    scale = x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), x / scale])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 0.1 * np.append(0, beta[1:])
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(np.append(1e-6, np.full(len(scale), 0.1)))
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
    loss = -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
    return float(loss), [float(b) for b in (beta[0], *(beta[1:] / scale))]


def _evidence(models, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column as it is, then each model's evidence."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        got = [[x for m in models.value for x in m.evidence(t or b"")] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], ["key", "evidence"])


def score(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts have no evidence: their score is the curve's at zero. Labels without a document or with a
    null or other class are skipped; repeated ones count once, and not at all if they differ. Without any label every score is 0. Rows
    that repeat a doc_id are scored each.
    """
    scored = _scored(docs, labels, sample_docs)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scored(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, hash, score) for each row of ``docs``; hash: that of its text."""
    spark = docs.sparkSession
    toxic = F.col("toxic").cast("int")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), toxic.alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(~held_out("doc_id"))
    known = given.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").select("doc_id", "toxic")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))
    share = F.when(F.col("toxic") == 1, sample_docs / max(1, sizes.get(1, 0))).otherwise(sample_docs / max(1, sizes.get(0, 0)))
    sample = known.filter(draw < share * (1 << 20)).select("toxic", F.col("doc_id").alias("_sampled"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample is drawn from distinct documents, about sample_docs of a class; of rows that repeat one the least text is taken
    met = texts.filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(sample), F.col("doc_id") == F.col("_sampled"))
    train = settle(met.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")))
    counted = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    grams = train.filter(counted).select("toxic", "text").mapInArrow(_count, "a binary, b binary, toxic long, plain long")
    grams = settle(grams.groupBy("a", "b").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")))
    enough = F.col("toxic") + F.col("plain") >= LEAST_COUNTS[0]
    before = grams.filter("a is not null").groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    singles = grams.filter("a is null and octet_length(b) > 0").join(before, "b", "left").select("b", "toxic", "plain", F.coalesce("n", F.lit(0)).alias("n"))
    unigrams = sorted((bytes(r["b"]), r["toxic"], r["plain"], r["n"]) for r in singles.filter(enough).collect())
    rest = tuple(singles.filter(~enough).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("toxic", "plain", "n"))).first())
    bigrams = sorted((bytes(r["a"]), bytes(r["b"]), r["toxic"], r["plain"]) for r in grams.filter("a is not null").filter(enough).collect())
    models = [Model(unigrams, bigrams, rest, least) for least in LEAST_COUNTS]
    model, curve = models[0], [-40.0, 0.0, 0.0]
    if sizes.get(1):
        tried = spark.sparkContext.broadcast(models)
        seen = train.filter(~counted).select(F.col("toxic").cast("long"), "text").mapInArrow(lambda it: _evidence(tried, it), "toxic long, evidence array<double>").collect()
        if any(r["toxic"] for r in seen):
            x, y = np.array([r["evidence"] for r in seen]), np.array([r["toxic"] for r in seen], float)
            fits = [fit_curve(x[:, 2 * k : 2 * k + 2], y, sizes[1] / sum(sizes.values())) for k in range(len(models))]
            best = min(range(len(models)), key=lambda k: fits[k][0])
            model, curve = models[best], fits[best][1]
        tried.unpersist()
    chosen = spark.sparkContext.broadcast([model])
    keyed = texts.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), "text")
    found = keyed.mapInArrow(lambda it: _evidence(chosen, it), "key struct<doc_id:long,hash:long>, evidence array<double>")
    z = F.lit(curve[0]) + F.lit(curve[1]) * F.col("evidence")[0] + F.lit(curve[2]) * F.col("evidence")[1]
    return found.select("key.doc_id", "key.hash", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns stay as they are. A row is told by its doc_id and text."""
    bad_id, bad_hash = free(docs.columns, "bad_id", "bad_hash")
    bad = _scored(docs, labels).filter("score >= 0.5").select(F.col("doc_id").alias(bad_id), F.col("hash").alias(bad_hash)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(bad_hash)), "left_anti")
