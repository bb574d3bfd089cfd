"""Toxic passages by maximum-scoring segments over token log-odds.

Learning, from labelled rows only (a bounded sample, ``MAX_ROWS``):
* token log-odds of toxic against clean with an informative Dirichlet prior (the pooled counts, ``PRIOR``
  of their mass), z-scored.  Tokens are words and, one level coarser, their first five and four letters:
  a word that was hardly seen takes the score of its longest prefix that is significant;
* a quarter of the rows isn't counted but calibrates.  Clean rows give the extreme-value law of the best
  segment, P(S >= x) = 1 - exp(-K n exp(-lambda x)), with lambda from the token score distribution and K
  by maximum likelihood; then a two-variable logistic curve turns significance into a probability.

Scoring: every word has a score; all maximal-scoring segments come from one linear scan (a stack of
disjoint candidates).  A segment of score S in a text of n words has significance
lambda S - ln(K n); those above ``SIGNIFICANT`` are reported as passages.

Words are runs of letters and digits of any script.  A run of more than ``LONG`` characters, as scripts without spaces have them,
counts as its overlapping pieces of ``PIECE`` characters.

Bounds: ``MAX_ROWS`` labelled rows; what is learned from them must fit ``MAX_TOKENS`` tokens, or :func:`fit` raises an error (a
smaller sample helps).  Nothing is cut to fit.

Defined cases: null and empty texts have no words and get the score of a text without any passage.  Labels
that are null or whose ``doc_id`` is null are ignored; several labels of one ``doc_id`` count as toxic
if one says so.  Repeated documents are scored row by row; in learning, rows equal in id and text are one.  Very long texts are scored
whole.  Ties in a token's score change nothing.  Without any toxic or any clean label all
scores are the share of toxic labels (0 without labels); without documents there are none.  Input columns come back in the struct
``row``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, materialize, packed, texts_of, tidy

MAX_ROWS, MAX_TOKENS = 100_000, 1_000_000
PRIOR, Z, SEEN = 0.1, 3.0, 5
LONG, PIECE = 32, 4
#: Words that a task counts before it passes them on.
COUNTED = 50_000
#: Score of a word that tells nothing; two strong words some dozen words apart still form one passage.
IDLE = -0.1
SIGNIFICANT = 3.0
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RUN = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8, long runs in pieces."""
    if not text:
        return []
    if text.isascii():
        words = text.lower().encode().translate(_TABLE).split()
    else:
        words = [w.encode() for w in _RUN.findall(text.lower())]
    if not words or len(max(words, key=len)) <= LONG:
        return words
    out: list[bytes] = []
    for w in words:
        run = w.decode() if len(w) > LONG else ""
        out += [run[i : i + PIECE].encode() for i in range(len(run) - PIECE + 1)] if len(run) > LONG else [w]
    return out


def prefixes(word: bytes) -> tuple[bytes, ...]:
    """Keys of a word, finest first; the mark tells the level."""
    letters = word.decode("utf-8", "replace")
    return (b"w" + word, b"5" + letters[:5].encode(), b"4" + letters[:4].encode())


class TokenScores(dict):
    """Word -> score with back-off, remembered up to a bound."""

    def __init__(self, known: dict[bytes, float]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> float:
        s = next((self.known[k] for k in prefixes(word) if k in self.known), IDLE)
        if len(self) > 300_000:
            self.clear()
        self[word] = s
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score), in linear time.

    Candidates wait on a stack with the running totals before and after them; a new one joins back to
    the nearest candidate that began lower, if it ends higher.  ``link`` jumps over candidates that began no lower.
    """
    total = np.r_[0.0, np.cumsum(scores)]
    starts: list[int] = []
    ends: list[int] = []
    link: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        begin, end = i, i + 1
        while True:
            j = len(starts) - 1
            while j >= 0 and total[starts[j]] >= total[begin]:
                j = link[j]
            if j < 0 or total[ends[j]] >= total[end]:
                starts.append(begin), ends.append(end), link.append(j)
                break
            begin = starts[j]
            del starts[j:], ends[j:], link[j:]
    return [(s, e, float(total[e] - total[s])) for s, e in zip(starts, ends)]


@dataclass
class Model:
    known: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    k: float = 1.0
    curve: tuple[float, float, float] | None = None
    base: float = 0.0

    def level(self, n: int) -> float:
        """ln(K n): what chance reaches in ``n`` words; short texts get no bonus for being short."""
        return math.log(max(self.k * n, 1.0))

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """Significance of the best segment, and the sum over the significant ones."""
        level = self.level(n)
        all_of = [self.rate * s - level for _, _, s in found]
        return max([-level, *all_of]), math.log1p(sum(x for x in all_of if x > 0))

    def probability(self, found: list[tuple[int, int, float]], n: int) -> float:
        if self.curve is None:
            return self.base
        best, total = self.evidence(found, n)
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * best + c * total))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        keys: dict[bytes, list[int]] = {}
        for y, seen in enumerate(counted):
            for word, n in seen.items():
                for key in prefixes(word):
                    keys.setdefault(key, [0, 0])[y] += n
            seen.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(keys), pa.binary()), pa.array([v[0] for v in keys.values()], pa.int64()), pa.array([v[1] for v in keys.values()], pa.int64())],
            ["token", "clean", "toxic"],
        )

    counted = (Counter(), Counter())
    for b in batches:
        for text, y in zip(b.column(0), b.column(1)):
            counted[y.as_py()].update(set(words_of(text.as_py())))
            if len(counted[0]) + len(counted[1]) > COUNTED:
                yield flush()
    yield flush()


def _evidence(known: dict[bytes, float]):
    """Per calibration row: label, number of words, best segment, all positive segments, histogram of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenScores(known)
        for b in batches:
            out: list[tuple] = []
            for text, y in zip(b.column(0), b.column(1)):
                words = words_of(text.as_py())
                s = np.fromiter(map(table.__getitem__, words), float, len(words))
                value, n = np.unique(np.round(s, 1), return_counts=True)
                out.append((y.as_py(), len(words), [x for _, _, x in segments(s)], value, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64())), pa.array([o[3] for o in out], pa.list_(pa.float64())), pa.array([o[4] for o in out], pa.list_(pa.int64()))],
                ["y", "n", "segments", "value", "count"],
            )

    return run


def _rate(value: np.ndarray, count: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1, or 1 (the theory's value for log-odds) without one."""
    if not len(value) or value.max() <= 0 or value @ count >= 0:
        return 1.0
    share, low, high = count / count.sum(), 0.0, 1.0
    at = lambda x: float(share @ np.exp(np.minimum(x * value, 500))) - 1
    while at(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        low, high = (low, mid) if at(mid := (low + high) / 2) > 0 else (mid, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_tokens: int = MAX_TOKENS) -> Model:
    """Learn from ``labels(doc_id, toxic)`` and the texts of those rows; ``max_rows`` bounds the sample
    (by a hash of the id, so no end of the table is preferred); more than ``max_tokens`` telling tokens are an error."""
    one = materialize(
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")),
        "labels",
    )
    n = one.count()
    if n > max_rows:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_rows)
    total = one.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    if not total.n or total.toxic in (0, total.n):
        return Model(base=total.toxic / total.n if total.n else 0.0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(one), "doc_id")
    # Copies of a row would come into the calibration all together.
    texts = materialize(texts.groupBy("doc_id", "y", F.md5(F.col("text").cast("binary")).alias("mark")).agg(F.first("text").alias("text")), "texts")
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0
    tokens = materialize(
        texts.where(~held).select("text", "y")
        .mapInArrow(tidy(_counts), "token binary, clean long, toxic long")
        .groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "tokens",
    )
    level = F.substring("token", 1, 1)
    sums = {bytes(r.l): (r.c, r.t) for r in tokens.groupBy(level.alias("l")).agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).collect()}
    if not sums:
        return Model(base=total.toxic / total.n)
    c, t = sums[b"w"]
    prior = PRIOR * (c + t)
    alpha = F.lit(PRIOR) * (F.col("clean") + F.col("toxic"))
    odds = F.log((F.col("toxic") + alpha) / F.lit(t + prior)) - F.log((F.col("clean") + alpha) / F.lit(c + prior))
    z = odds / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    scored = tokens.select("token", odds.alias("odds"), z.alias("z"), (F.col("clean") + F.col("toxic")).alias("n"))
    strong = bounded_rows(scored.where((F.abs("z") >= Z) & (F.col("n") >= SEEN)), max_tokens, "the table of telling tokens")
    known = {bytes(r.token): float(r.odds) if r.odds > 0 else max(float(r.odds), -1.0) for r in strong}
    # Words seen often enough to speak for themselves don't take their prefix's score.
    heads = [bytes(r.token) for r in strong if bytes(r.token)[:1] != b"w"]
    if heads:
        spark = docs.sparkSession
        head = F.broadcast(spark.createDataFrame([(bytearray(h),) for h in heads], "head binary"))
        word = F.decode(F.substring(F.col("token"), 2, 4 * LONG), "UTF-8")  # words have LONG characters at most
        plain = scored.where((level == F.lit(b"w")) & (F.abs("z") < Z) & (F.col("n") >= SEEN))
        keys = F.explode(F.array(*[F.encode(F.concat(F.lit(str(k)), F.substring(word, 1, k)), "UTF-8") for k in (5, 4)]))
        own = plain.select("token", keys.alias("head")).join(head, "head", "left_semi").select("token").distinct()
        for r in bounded_rows(own, max_tokens, "the table of words that tell nothing"):
            known.setdefault(bytes(r.token), IDLE)
    shown = texts.where(held)
    n = shown.count()
    if n > max_rows:  # one id with many texts
        shown = shown.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n)) < max_rows * 9 // 10)
    seen = materialize(
        shown.select("text", "y").mapInArrow(tidy(_evidence(known)), "y int, n long, segments array<double>, value array<double>, count array<long>"), "calibration"
    )
    model = Model(known=known, base=total.toxic / total.n)
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    rows = bounded_rows(seen.select("y", "n", best.alias("best")), max_rows, "calibration rows")
    if len({r.y for r in rows}) < 2:
        return model
    # A score is a multiple of 0.1 here, so there are few values.
    pairs = seen.where("y = 0").select(F.explode(F.arrays_zip("value", "count")).alias("p"))
    hist = sorted((r.value, r.n) for r in pairs.groupBy(F.col("p.value").alias("value")).agg(F.sum("p.count").alias("n")).collect())
    model.rate = _rate(np.array([v for v, _ in hist]), np.array([n for _, n in hist], float))
    clean = [r for r in rows if not r.y and r.n]
    gumbel = sum(r.n * math.exp(-model.rate * r.best) for r in clean)
    model.k = len(clean) / gumbel if gumbel else 1.0
    # The evidence of every calibration row from all its segments, as in scoring.
    level = F.log(F.greatest(F.lit(model.k) * F.col("n"), F.lit(1.0)))
    gains = F.transform("segments", lambda s: F.greatest(F.lit(model.rate) * s - level, F.lit(0.0)))
    evidence = seen.select("y", F.greatest(-level, F.lit(model.rate) * best - level).alias("best"), F.log1p(F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)).alias("total"))
    rows = sorted(bounded_rows(evidence, max_rows, "calibration rows"))
    model.curve = tuple(map(float, _logistic(np.array([(r.best, r.total) for r in rows]), np.array([r.y for r in rows]))))
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenScores(model.known)
        for b in batches:
            score, start, end, strength = [], [], [], []
            for text in texts_of(b):
                words = words_of(text.as_py())
                s = np.fromiter(map(table.__getitem__, words), float, len(words))
                found = segments(s)
                level = model.level(len(words))
                shown = [(p, q, model.rate * x - level) for p, q, x in found if model.rate * x - level >= SIGNIFICANT]
                score.append(model.probability(found, len(words)))
                start.append([p for p, _, _ in shown]), end.append([q for _, q, _ in shown]), strength.append([x for _, _, x in shown])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(score, pa.float64()), pa.array(start, ints), pa.array(end, ints), pa.array(strength, pa.list_(pa.float64()))],
                ["row", "score", "starts", "ends", "significance"],
            )

    return run


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``row, score, starts, ends, significance``: probability and the significant passages (in words) of every row; ``row`` has
    the columns in ``carry`` (all)."""
    rows = packed(docs, carry)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(tidy(_score(model)), f"row {kind}, score double, starts array<int>, ends array<int>, significance array<double>")
