"""Language-model scoring with a log-bilinear model.

Counts of every token of every training text give the base: an add-0.1 unigram model. On top of it a log-bilinear
model predicts classes of tokens - the most frequent words, the end, and one class for all other words - from the two
tokens before: the context vectors, each scaled by its position's weights, sum to a prediction whose inner products
with the class vectors, plus biases, are the scores. It is trained in numpy by noise-contrastive estimation on every
training text: each partition runs once over its texts from a common start, and the parameters are averaged by tokens.

Scoring needs normalised probabilities. As the score is a sum over the two positions, the normalisers of all contexts
are one matrix product of exponentials, so a token costs three table look-ups. A word of the other class has the
class's probability times its share of that class in the base. Counts of frequent words (bounded in number) are sent
out; all other words meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, groups, settle, table

#: Classes, vector length, noise samples of a batch, tokens of a batch, and the step of AdaGrad.
CLASSES, SIZE, NOISE, BATCH, RATE = 2048, 16, 24, 2048, 0.1
#: Words whose counts are sent out, at most, and the longest of them.
SENT, SENT_BYTES = 250_000, 64
#: Training texts that give the common start, about, and tokens in them, about: rows are drawn with a share that keeps to both.
START_DOCS, START_TOKENS = 2000, 2_000_000
END, OTHER = 0, 1
SMOOTH = 0.1


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, at times more than once; the empty word is the end."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            counts.update(words(text))
            counts[b""] += 1
            if len(counts) > 400_000:
                yield flush()
                counts.clear()
    if counts:
        yield flush()


class Vocabulary:
    """The words sent out, most frequent first, with their counts; total, kinds: of all training tokens."""

    def __init__(self, sent: list[tuple[bytes, int]], ends: int, total: int, kinds: int, classes: int):
        self.rank = {w: k for k, (w, _) in enumerate(sent)}
        counts = np.array([n for _, n in sent], float)
        named = min(classes - 2, len(sent))
        self.denominator = total + SMOOTH * (kinds + 1)
        self.total, self.ends = total, ends
        log = lambda n: np.log10((n + SMOOTH) / self.denominator) if self.denominator else n * 0.0
        self.base = np.append(log(counts), [0.0, log(np.float64(ends))])  # then any word not sent, and the end
        self.classes = np.append(np.minimum(np.arange(len(sent)) + 2, 2 + named), [0, END])
        self.classes[self.classes >= 2 + named] = OTHER
        self.classes[len(sent)] = OTHER
        n = np.concatenate([[ends, 0.0], counts[:named]])
        n[OTHER] = max(0.0, total - n.sum())
        self.noise = (n + 1) / (n + 1).sum()
        mass = 1 - (n[[END, *range(2, 2 + named)]] + SMOOTH).sum() / self.denominator if self.denominator else 1.0
        self.other = math.log10(max(mass, 1e-300))

    def ranks(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Ranks of all tokens, an end after each text; where each text begins; the words."""
        found = [words(t) for t in texts]
        get, missing, end = self.rank.get, len(self.rank), len(self.rank) + 1
        flat = [r for f in found for r in (*(get(w, missing) for w in f), end)]
        starts = np.cumsum([0, *(len(f) + 1 for f in found)])[:-1]
        return np.array(flat, np.int64), starts, found


def contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before; before a text there are ends."""
    one = np.append(END, classes[:-1])
    two = np.append(END, one[:-1])
    one[starts] = END
    two[starts] = END
    return one, two


class LogBilinear:
    def __init__(self, noise: np.ndarray, size: int = SIZE):
        draw = np.random.default_rng(7)
        k = len(noise)
        self.log_noise = np.log(noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.context = draw.normal(0, 0.1, (k, size)).astype(np.float32)
        self.target = draw.normal(0, 0.1, (k, size)).astype(np.float32)
        self.position = np.ones((2, size), np.float32)
        self.bias = self.log_noise.copy()

    def rows(self) -> np.ndarray:
        """All parameters as rows of size + 1 numbers: contexts, targets with biases, positions."""
        zero = lambda n: np.zeros((n, 1), np.float32)
        return np.vstack([np.hstack([self.context, zero(len(self.context))]), np.hstack([self.target, self.bias[:, None]]), np.hstack([self.position, zero(2)])])

    def load(self, rows: np.ndarray) -> LogBilinear:
        k = len(self.bias)
        rows = rows.astype(np.float32)
        self.context, self.target, self.bias, self.position = rows[:k, :-1].copy(), rows[k : 2 * k, :-1].copy(), rows[k : 2 * k, -1].copy(), rows[2 * k :, :-1].copy()
        self.squares = None
        return self

    squares = None

    def train(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, draw: np.random.Generator) -> None:
        """A pass over the tokens in the order given, by AdaGrad on the noise-contrastive loss."""
        k = len(self.bias)
        if self.squares is None:
            # a batch's shared noise hits a rare class seldom and then hard, so its rows begin with that hit's square
            hit = (BATCH / (NOISE + 1)) ** 2
            self.squares = [np.full(x.shape, s, np.float32) for x, s in ((self.context, 0.01), (self.target, 0.1 * hit), (self.position, 1.0), (self.bias, hit))]
        for at in range(0, len(word), BATCH):
            a, b, w = one[at : at + BATCH], two[at : at + BATCH], word[at : at + BATCH]
            noise = np.minimum(np.searchsorted(self.cumulative, draw.random(NOISE)), k - 1)
            ca, cb, tw, tn = self.context[a], self.context[b], self.target[w], self.target[noise]
            guess = ca * self.position[0] + cb * self.position[1]
            right = (guess * tw).sum(axis=1) + self.bias[w] - self.log_noise[w] - np.float32(math.log(NOISE))
            wrong = guess @ tn.T + (self.bias[noise] - self.log_noise[noise] - np.float32(math.log(NOISE)))
            gr = -1 / (1 + np.exp(np.clip(right, -30, 30)))
            gw = 1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
            dg = gr[:, None] * tw + gw @ tn
            grads = [np.zeros_like(self.context), np.zeros_like(self.target), np.stack([(dg * ca).sum(axis=0), (dg * cb).sum(axis=0)]), np.bincount(w, gr, minlength=k).astype(np.float32)]
            _scatter(grads[0], a, dg * self.position[0])
            _scatter(grads[0], b, dg * self.position[1])
            _scatter(grads[1], w, gr[:, None] * guess)
            np.add.at(grads[1], noise, gw.T @ guess)
            np.add.at(grads[3], noise, gw.sum(axis=0))
            for x, s, g in zip((self.context, self.target, self.position, self.bias), self.squares, grads):
                s += g * g
                x -= np.float32(RATE) * g / np.sqrt(s)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By class one before, by class two before (with the biases), and the log normaliser of both."""
        first = np.clip((self.context * self.position[0]) @ self.target.T, -40, 40)
        second = np.clip((self.context * self.position[1]) @ self.target.T + self.bias, -60, 40)
        total = np.exp(first, dtype=np.float64) @ np.exp(second, dtype=np.float64).T
        return first.astype(np.float32), second.astype(np.float32), np.log(total).astype(np.float32)


def _scatter(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    keys = at[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    if len(begin):
        into[keys[begin]] += np.add.reduceat(rows[order], begin, axis=0)


def _train(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The parameters after this partition's texts, times its tokens."""
    vocabulary, start = shared.value
    model, seen, draw = LogBilinear(vocabulary.noise).load(start), 0, np.random.default_rng(11)
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for at, end in groups(texts, 512):
            ranks, starts, _ = vocabulary.ranks(texts[at:end])
            classes = vocabulary.classes[ranks]
            one, two = contexts(classes, starts)
            mixed = draw.permutation(len(classes))
            model.train(one[mixed], two[mixed], classes[mixed], draw)
            seen += len(classes)
    if seen:
        rows = model.rows().astype(np.float64) * seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), float(seen)))] + [pa.array(rows[:, k]) for k in range(rows.shape[1])], ["row", "tokens", *(f"v{k}" for k in range(rows.shape[1]))])


_PART = "word binary, uid long, times long, doc_id long, n_tokens long, n_known long, base double, model double"
_PART_PA = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row for each text with what the words sent out give, and one for each other word in it.

    A text's own row has a word that no text has (a line feed, then the row's number), so it meets no count.
    """
    from pyspark import TaskContext

    vocabulary, (first, second, total) = shared.value
    uid, missing = TaskContext.get().partitionId() << 33, len(vocabulary.rank)
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for at, end in groups(texts, 256):
            ranks, starts, found = vocabulary.ranks(texts[at:end])
            classes = vocabulary.classes[ranks]
            one, two = contexts(classes, starts)
            log = (first[one, classes].astype(np.float64) + second[two, classes] - total[one, two]) / math.log(10)
            rare = ranks == missing
            other = classes == OTHER
            log[other] += vocabulary.base[ranks[other]] - vocabulary.other
            sums = [np.add.reduceat(x, starts).tolist() for x in (vocabulary.base[ranks], log, (~rare).astype(np.int64))]
            sizes = np.diff(np.append(starts, len(ranks))).tolist()
            n = len(sizes)
            get = vocabulary.rank.get
            words_, uids, times = [], [], []
            for k, f in enumerate(found):
                seen = Counter(w for w in f if get(w) is None)
                words_ += seen.keys()
                times += seen.values()
                uids += [uid + k] * len(seen)
            own = list(range(uid, uid + n))
            m = len(words_)
            none = [None] * m
            columns = [
                [b"\n%d" % u for u in own] + words_, own + uids, [0] * n + times, docs[at:end] + none, sizes + none, sums[2] + none, sums[0] + none, sums[1] + none
            ]
            if not vocabulary.ends:
                columns[5] = [0] * n + none
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_PA)], [c.split()[0] for c in _PART.split(", ")])
            uid += n


def score(docs: DataFrame, classes: int = CLASSES, sent: int = SENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    A null or empty text is its end alone. A null doc_id is a training text. Without training texts nothing is known
    and every probability is that of the smoothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = texts.filter(~held_out())
    counts = settle(train.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, kinds, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))).first()
    level = F.floor(F.log2("n") * 16)
    short = counts.filter(f"octet_length(word) between 1 and {SENT_BYTES}")
    histogram = sorted(((r["level"], r["kinds"]) for r in short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("kinds")).collect()), reverse=True)
    least, room = math.inf, sent
    for at, n in histogram:  # whole levels of frequency, as long as they have room
        if n > room:
            break
        least, room = at, room - n
    chosen = short.filter(level >= least).select("word", "n").toArrow() if least < math.inf else None
    frequent = list(zip(chosen["word"].to_pylist(), chosen["n"].to_pylist())) if chosen else []
    del chosen
    vocabulary = Vocabulary(sorted(frequent, key=lambda x: (-x[1], x[0])), ends, total, kinds, classes)
    model = LogBilinear(vocabulary.noise)
    if ends:
        # rows, not texts, are drawn: a text that many rows repeat comes with its share of them
        start = train.filter(F.rand(5) < min(START_DOCS / ends, START_TOKENS / total)).select("text").collect()
        ranks, starts, _ = vocabulary.ranks([(r["text"] or "").encode() for r in start])
        if len(ranks):
            named, draw = vocabulary.classes[ranks], np.random.default_rng(5)
            one, two = contexts(named, starts)
            for _ in range(2):
                mixed = draw.permutation(len(named))
                model.train(one[mixed], two[mixed], named[mixed], draw)
        shared = spark.sparkContext.broadcast((vocabulary, model.rows()))
        values = [f"v{k}" for k in range(SIZE + 1)]
        parts = train.select("text").mapInArrow(lambda it: _train(it, shared), "row long, tokens double, " + ", ".join(f"{v} double" for v in values))
        mean = parts.groupBy("row").agg(*((F.sum(v) / F.sum("tokens")).alias(v) for v in values)).collect()
        model.load(np.array([[r[v] for v in values] for r in sorted(mean, key=lambda r: r["row"])]))
    tables = spark.sparkContext.broadcast((vocabulary, model.tables()))
    parts = texts.mapInArrow(lambda it: _score(it, tables), _PART)
    log = F.log10((F.coalesce("n", F.lit(0)) + SMOOTH) / F.lit(float(vocabulary.denominator or 1)))
    met = parts.join(counts.filter("octet_length(word) > 0"), "word", "left").select(
        "uid", "doc_id", "n_tokens", F.when(F.col("times") > 0, F.when(F.col("n") > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"), "base", "model", F.when(F.col("times") > 0, F.col("times") * log).otherwise(0.0).alias("rare")
    )
    by = met.groupBy("uid").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_tokens", "base", "model")), F.sum("n_known").alias("n_known"), F.sum("rare").alias("rare"))
    return by.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("rare")).alias("base_score"), (F.col("model") + F.col("rare")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
