"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from four fixed patterns with their checks. Further candidates come from wider patterns: obfuscated
mail addresses, IPv6, bare card numbers, phone numbers without a plus, secrets. Three labelers vote on a candidate (yes,
no, or nothing): a regex labeler that checks its form, a gazetteer labeler that knows domains, card networks, area codes
and key prefixes, and a context labeler that reads the words before it. Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is for each kind; its posteriors train a logistic span classifier, which decides.
Only tables of counts (a bounded number of vote patterns and features) come to the driver.

Positions are code points; the end is exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns. Possessive repeats and the look-behind only keep Java from trying again what can't match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\s{0,2}[\[(]\s?(?:at|AT)\s?[\])]\s{0,2}[A-Za-z0-9-]++(?:(?:\.|\s{0,2}[\[(]\s?(?:dot|DOT)\s?[\])]\s{0,2})[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,37}::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{12,19}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?:(?:sk|pk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,}+|AKIA[0-9A-Z]{16}|[0-9a-f]{32,}+)(?![A-Za-z0-9_-])",
}
#: A text without this has no match of the wide pattern.
_NEEDS = {"email": r"[\[(]\s?(?:at|AT)\s?[\])]", "ip": ":[0-9A-Fa-f]{0,4}:", "card": "[0-9]{12}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}", "secret": "[0-9a-f]{32}|[-_][A-Za-z0-9_-]{16}|AKIA"}
#: Gazetteers: top-level domains, card networks' first digits, key prefixes.
DOMAINS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|jp|cn|in|br|au|ch|at"
NETWORKS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
PREFIXES = "^(?:sk|pk|ghp|xoxb|AKIA)"
#: Context words, before a candidate, by kind; and words that speak against any.
_SAYS = {"email": "mail|contact|write|reach", "ip": "ip|address|host|server|from|by", "card": "card|visa|mastercard|amex|credit|pay", "phone": "phone|tel|call|mobile|fax|dial|contact", "secret": "token|key|secret|password|passwd|bearer|auth|credential"}
_AGAINST = "version|isbn|order|invoice|section|chapter|page|sha|md5|commit|checksum|serial|part"
_CONTEXT = 40


def _scan(items: str, start: str, kind: str, state: str, item: str, chunk: int = 128) -> str:
    """SQL of the array of ``item`` of each x of an array, i.st being what ``state`` has made of those before it.

    An array that grows is copied at each step, so it grows by chunks and the chunks are joined at the end: long arrays
    take linear time. kind: the type of an item.
    """
    inner = f"aggregate(c, named_struct('st', a.st, 'out', cast(array() as array<{kind}>)), (i, x) -> named_struct('st', {state}, 'out', concat(i.out, array({item}))))"
    step = f"element_at(transform(array({inner}), r -> named_struct('st', r.st, 'out', concat(a.out, array(r.out)))), 1)"
    chunks = f"transform(sequence(1, greatest(size(z), 1), {chunk}), k -> slice(z, k, {chunk}))"
    whole = f"aggregate({chunks}, named_struct('st', {start}, 'out', cast(array() as array<array<{kind}>>)), (a, c) -> {step}, a -> flatten(a.out))"
    return f"element_at(transform(array({items}), z -> {whole}), 1)"


def _found(text: str, pattern: str, needs: str) -> str:
    """SQL of the array of (start, end, hit, before) of a pattern's matches; before: up to 40 characters in lower case."""
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    n = "r'" + needs.replace("'", r"\x27") + "'"
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0))"
    pieces = f"filter(transform({zipped}, z -> named_struct('piece', z.`0`, 'hit', z.`1`)), z -> z.hit is not null)"
    kind = "struct<start:int,end:int,hit:string,before:string>"
    item = "named_struct('start', i.st + length(x.piece), 'end', i.st + length(x.piece) + length(x.hit), 'hit', x.hit, 'before', lower(right(x.piece, %d)))" % _CONTEXT
    scan = _scan(pieces, "0", kind, "i.st + length(x.piece) + length(x.hit)", item)
    return f"case when {text} rlike {n} then {scan} else cast(array() as array<{kind}>) end"


def _luhn(hit: str) -> str:
    digits = f"reverse(regexp_replace({hit}, '[^0-9]', ''))"
    twice = "cast(substring(d, i, 1) as int) * (2 - i % 2)"
    total = f"aggregate(transform(array({digits}), d -> aggregate(sequence(1, greatest(length(d), 1)), 0, (s, i) -> s + {twice} - if({twice} > 9, 9, 0))), 0, (s, v) -> s + v)"
    return f"(length({digits}) between 12 and 19 and coalesce({total}, 1) % 10 = 0)"


#: The checks of the base spans.
_VALID = {
    "email": "true",
    "ip": "forall(split(s.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": _luhn("s.hit"),
    "phone": "length(regexp_replace(s.hit, '[^0-9]', '')) between 9 and 15",
}
#: The regex and gazetteer labelers: 1 for, 0 against, -1 for no vote.
_FORM = {
    "email": "if(s.hit rlike '[A-Za-z]', 1, 0)",
    "ip": "if(s.hit rlike '[0-9]' and s.hit rlike '[1-9A-Fa-f].*:.*[0-9A-Fa-f]', 1, 0)",
    "card": f"if({_luhn('s.hit')}, 1, 0)",
    "phone": r"if(regexp_replace(s.hit, '[^0-9]', '') rlike '^[2-9][0-9]{2}[0-9]{7}$', 1, 0)",
    "secret": "if(s.hit rlike '[0-9]' and s.hit rlike '[A-Za-z]', 1, 0)",
}
_KNOWN = {
    "email": f"if(lower(s.hit) rlike '(?:[.]|dot.{{0,3}})(?:{DOMAINS})$', 1, -1)",
    "ip": "if(lower(s.hit) rlike '^(?:2[0-9a-f]{3}|fe80|fd)', 1, -1)",
    "card": f"if(s.hit rlike '{NETWORKS}', 1, 0)",
    "phone": "if(s.hit rlike '^[(]?(?:[2-9][0-8][0-9])', 1, 0)",
    "secret": f"if(s.hit rlike '{PREFIXES}', 1, -1)",
}


def _says(kind: str) -> str:
    return f"case when s.before rlike '(?:^|[^a-z])(?:{_SAYS[kind]})[a-z]{{0,2}}[^a-z]*$' then 1 when s.before rlike '(?:^|[^a-z])(?:{_AGAINST})[^a-z]*$' then 0 else -1 end"


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, wide): arrays of base spans (start, rank, end) and of candidates with their votes and features."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    needs = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
    found = rows.select("doc_id", *(F.expr(_found("text", BASE[k], needs[k])).alias(f"b{r}") for r, k in enumerate(BASE)), *(F.expr(_found("text", WIDE[k], _NEEDS[k])).alias(f"w{r}") for r, k in enumerate(KINDS)))
    base = ", ".join(f"transform(filter(b{r}, s -> {_VALID[k]}), s -> named_struct('start', s.start, 'rank', {r}, 'end', s.end))" for r, k in enumerate(BASE))
    wide = ", ".join(
        f"transform(w{r}, s -> named_struct('start', s.start, 'rank', {r}, 'end', s.end, 'form', {_FORM[k]}, 'known', {_KNOWN[k]}, 'says', {_says(k)},"
        f" 'size', least(5, cast((s.end - s.start) div 8 as int)), 'digits', cast(4 * length(regexp_replace(s.hit, '[^0-9]', '')) div (s.end - s.start) as int)))"
        for r, k in enumerate(KINDS)
    )
    met = found.select("doc_id", F.expr(f"array_sort(concat({base}))").alias("base"), F.expr(f"array_sort(concat({wide}))").alias("wide"))
    # a candidate over a base span, or over one that begins before it or is of an earlier kind, is no news: a sweep forward
    # with the furthest ends so far, and one back with the next base span's start
    events = "array_sort(concat(transform(base, b -> named_struct('start', b.start, 'side', 0, 'rank', b.rank, 'end', b.end, 'at', -1)), transform(wide, (w, k) -> named_struct('start', w.start, 'side', 1, 'rank', w.rank, 'end', w.end, 'at', k))))"
    seen = _scan(
        events, "named_struct('b', 0, 'w', 0)", "struct<start:int,end:int,at:int,bad:boolean>", "named_struct('b', if(x.at < 0, greatest(i.st.b, x.end), i.st.b), 'w', if(x.at < 0, i.st.w, greatest(i.st.w, x.end)))",
        "named_struct('start', x.start, 'end', x.end, 'at', x.at, 'bad', i.st.b > x.start or i.st.w > x.start)",
    )
    clear = _scan(f"reverse({seen})", "2147483647", "struct<at:int,bad:boolean>", "if(x.at < 0, x.start, i.st)", "named_struct('at', x.at, 'bad', x.bad or i.st < x.end)")
    kept = f"if(size(wide) = 0, wide, transform(filter({clear}, x -> x.at >= 0 and not x.bad), x -> element_at(wide, x.at + 1)))"
    return met.select("doc_id", "base", F.expr(kept).alias("wide"))


def reliabilities(patterns: list[tuple[int, int, int, int, int]], rounds: int = 50) -> dict[tuple[int, int, int, int], float]:
    """Posterior of each (rank, form, known, says), given counts, by expectation-maximisation.

    Two classes for each kind; a labeler's three answers have probabilities by class. It starts from labelers that are
    right four times in five, and counts are smoothed, so a kind with few candidates keeps near that.
    """
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [p for p in patterns if p[0] == kind]
        votes, n = np.array([p[1:4] for p in rows]) + 1, np.array([p[4] for p in rows], float)
        prior, chance = 0.5, np.tile(np.array([[[0.3, 0.55, 0.15]], [[0.3, 0.15, 0.55]]]), (1, 3, 1))
        first = chance * 10
        post = np.full(len(rows), 0.5)
        for _ in range(rounds):
            log = np.log([1 - prior, prior])[:, None] + sum(np.log(chance[:, j, votes[:, j]]) for j in range(3))
            post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
            weight = np.stack([n * (1 - post), n * post])
            prior = (weight[1].sum() + 5) / (n.sum() + 10)
            for j in range(3):
                for a in range(3):
                    chance[:, j, a] = first[:, j, a] + weight[:, votes[:, j] == a].sum(axis=1)
            chance /= chance.sum(axis=2, keepdims=True)
        out |= {tuple(r[:4]): float(p) for r, p in zip(rows, post)}
    return out


def _features(rank: int, form: int, known: int, says: int, size: int, digits: int) -> list[float]:
    return [1.0, *(float(rank == k) for k in range(len(KINDS))), *(float(v == a) for v in (form, known, says) for a in (0, 1)), size / 5, digits / 4]


#: The same in SQL, of a candidate w.
_FEATURES = ["1.0D", *(f"if(w.rank = {k}, 1.0D, 0.0D)" for k in range(len(KINDS))), *(f"if(w.{v} = {a}, 1.0D, 0.0D)" for v in ("form", "known", "says") for a in (0, 1)), "w.size / 5.0D", "w.digits / 4.0D"]


def train(counts: list[tuple[int, ...]]) -> list[float]:
    """Coefficients of the span classifier from (rank, form, known, says, size, digits, n) rows, by ridge Newton steps."""
    if not counts:
        return [0.0] * len(_FEATURES)
    merged: dict[tuple, int] = {}
    for row in counts:
        merged[row[:4]] = merged.get(row[:4], 0) + row[6]
    post = reliabilities([(*k, n) for k, n in sorted(merged.items())])
    rows = sorted(counts)
    x, n, y = np.array([_features(*r[:6]) for r in rows]), np.array([r[6] for r in rows], float), np.array([post[r[:4]] for r in rows])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(beta)), x.T @ (n * (p - y)) + 0.5 * beta)
        beta -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return [0.0 if math.isnan(b) else float(b) for b in beta]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs``.

    A null or empty text has no spans; a text with many takes time in proportion. Rows that repeat a doc_id are read each. Without candidates nothing is added.
    """
    met = settle(spans(docs))
    votes = met.select(F.explode("wide").alias("w")).groupBy(*(F.col(f"w.{c}").alias(c) for c in ("rank", "form", "known", "says", "size", "digits"))).agg(F.count(F.lit(1)).alias("n"))
    beta = train([tuple(r) for r in votes.collect()])
    z = " + ".join(f"({b!r}D) * {f}" for b, f in zip(beta, _FEATURES))
    added = f"transform(filter(wide, w -> {z} > 0), w -> named_struct('start', w.start, 'rank', w.rank, 'end', w.end))"
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    text = lambda of: f"array_join(transform(array_sort({of}), s -> concat(element_at({names}, s.rank + 1), ':', s.start, ':', s.end)), ',')"
    return met.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, s -> s.rank = {r})) as bigint)").alias(f"n_{k}") for r, k in enumerate(BASE)),
        F.sha2(F.expr(text("base")), 256).alias("base_sha256"),
        F.expr(text(f"concat(base, {added})")).alias("spans"),
        F.expr(f"cast(size({added}) as bigint)").alias("n_added"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
