"""Quality rules: statistics of every text, and an isolation forest over them.

One pass computes the rule statistics.  The forest is fitted on three quarters of the labelled rows, all of them (on all
rows without labels).  Its ``TREES`` trees have random splits between the least and largest value of a random
statistic, so ordinary texts lie deep and odd ones are cut off early.  As the method has it, each tree's splits come from
``SAMPLE`` rows that it draws from all, good ones but for ``FEW``, so that odd rows are rare in a tree.  How many rows a leaf
holds isn't read off that draw: every row of the three quarters is sent down every tree and counted, good and odd ones apart, and
a leaf's size is the share of the good ones in it times those drawn, and of the odd ones likewise.  A text's anomaly is
2^(-mean path / expected path).  The threshold comes from all labelled rows of the quarter that the forest didn't see (by a hash of
the id): the largest sum of hit rate and pass rate, among thresholds that lose at most ``LOSS`` of the good rows.

Defined cases: null, empty and wordless texts have all statistics 0 and fail the base rules (too few words).  Labels that are
null are ignored; several labels of one ``doc_id`` count as good if one says so.  Without labels of both kinds the
forest rejects nothing.  Repeated documents are judged row by row; among labelled rows those equal in id and statistics are one, whose number counts in the threshold; ties in anomaly are never cut apart; very long texts are whole; without documents
there is no row; input columns come back in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_rows, materialize, packed, running_totals, texts_of, windows_hash

TREES, SAMPLE, FEW, MAX_ROWS, LOSS, SEED = 200, 256, 2, 50_000, 0.005, 7
# Fixed values of the rules.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics_of(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """:data:`STATS` of a text: words, their characters, symbols, repeated lines, words in repeated 5-word windows."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n >= 6:
        w = windows_hash(hashes.of(words), 5)
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        twice = np.zeros(len(w), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cover = np.zeros(n, bool)
        for i in range(5):
            cover[i : n - 4 + i] |= twice
        repeat = int(cover.sum())
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        rows = [statistics_of(t.as_py(), hashes) for t in texts_of(b)]
        cols = np.array(rows, np.int64).reshape(len(rows), len(STATS)).T
        yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c) for c in cols)], ["row", *STATS])


def text_statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` and :data:`STATS` for every row of ``docs(text, ...)``; ``row`` has the columns in ``carry`` (all)."""
    rows = packed(docs, carry)
    return rows.mapInArrow(_stats, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features(x: np.ndarray) -> np.ndarray:
    """Rows of :data:`STATS` -> rates: word length, symbols and repeated words per word.  Rates that depend on a text's length or hardly
    differ between good and bad rows are left out: each takes splits from the others."""
    words, chars, symbols, _, repeat = x.astype(float).T
    w = np.maximum(words, 1)
    return np.c_[chars / w, symbols / w, repeat / w]


class Forest:
    """Isolation trees as arrays: statistic (negative: leaf), split, children, path length of leaves."""

    def __init__(
        self, x: np.ndarray, odd: np.ndarray, trees: int = TREES, sample: int = SAMPLE, few: int = FEW, seed: int = SEED,
        drawn: list[tuple[np.ndarray, np.ndarray]] | None = None,
    ) -> None:
        """``drawn``: the rows of ``x`` and ``odd`` that each tree takes, if they are drawn already."""
        drawn = self.draw(len(x), len(odd), trees, sample, few, seed) if drawn is None else drawn
        self.ordinary, self.few = map(len, drawn[0])
        size = self.ordinary + self.few
        self.expected = max(self.average(size), 1e-9)
        limit = int(np.ceil(np.log2(max(size, 2))))
        rng = np.random.default_rng([seed, 1])
        self.trees = [self._grow(np.r_[x[a], odd[b]], limit, rng) for a, b in drawn]
        self.first = np.cumsum([0, *(len(t[0]) for t in self.trees)])

    @staticmethod
    def draw(ordinary: int, odd: int, trees: int = TREES, sample: int = SAMPLE, few: int = FEW, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tree the numbers of the rows it takes, of ``ordinary`` and of ``odd`` ones."""
        rng = np.random.default_rng(seed)
        few = min(few, odd)
        return [(rng.choice(ordinary, min(sample - few, ordinary), replace=False), rng.choice(odd, few, replace=False)) for _ in range(trees)]

    @staticmethod
    def average(n: int) -> float:
        """Mean path of an unsuccessful search among ``n`` keys."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, limit: int, rng: np.random.Generator):
        stat, split, left, right, path = [], [], [], [], []
        todo = [(x, 0, None)]
        while todo:
            rows, depth, parent = todo.pop()
            at = len(stat)
            if parent is not None:
                (left if parent[1] else right)[parent[0]] = at
            low, high = rows.min(0), rows.max(0)
            wide = np.flatnonzero(high > low)
            leaf = depth >= limit or len(rows) < 2 or not len(wide)
            k = 0 if leaf else int(rng.choice(wide))
            cut = 0.0 if leaf else float(rng.uniform(low[k], high[k]))
            stat.append(-1 if leaf else k), split.append(cut), left.append(at), right.append(at), path.append(depth + self.average(len(rows)) if leaf else 0.0)
            if not leaf:
                below = rows[:, k] < cut
                todo += [(rows[~below], depth + 1, (at, False)), (rows[below], depth + 1, (at, True))]
        return np.array(stat), np.array(split), np.array(left), np.array(right), np.array(path)

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of every row."""
        rows = np.arange(len(x))
        for stat, split, left, right, _ in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := stat[at] >= 0).any():
                k = stat[at]
                below = x[rows, np.maximum(k, 0)] < split[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            yield at

    def counts(self, x: np.ndarray) -> np.ndarray:
        """How many rows of ``x`` each leaf holds; trees one after the other, from ``first`` on."""
        return np.concatenate([np.bincount(at, minlength=len(t[0])) for at, t in zip(self.leaves(x), self.trees)])

    def weigh(self, good: np.ndarray, odd: np.ndarray) -> None:
        """Leaf sizes from :meth:`counts` of all rows, good and odd ones, scaled to the rows of a tree."""
        known = [self.average(n) for n in range(self.ordinary + self.few + 1)]
        for i, (stat, split, left, right, _) in enumerate(self.trees):
            own = slice(self.first[i], self.first[i + 1])
            size = self.ordinary * good[own] / max(good[own].sum(), 1) + self.few * odd[own] / max(odd[own].sum(), 1)
            depth = np.zeros(len(stat))
            for at in np.flatnonzero(stat >= 0).tolist():  # children come after their parents
                depth[left[at]] = depth[right[at]] = depth[at] + 1
            path = np.where(stat < 0, depth + np.interp(size, np.arange(len(known)), known), 0.0)
            self.trees[i] = (stat, split, left, right, path)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for at, tree in zip(self.leaves(x), self.trees):
            total += tree[4][at]
        return 2.0 ** (-total / len(self.trees) / self.expected)


def threshold(anomaly: np.ndarray, good: np.ndarray, loss: float = LOSS, copies: np.ndarray | None = None) -> float:
    """Reject above it; infinity if the labels are of one kind.  A row counts ``copies`` times."""
    if good.all() or not good.any():
        return float("inf")
    order = np.argsort(-anomaly, kind="stable")
    a, g = anomaly[order], good[order]
    w = np.ones(len(g), np.int64) if copies is None else copies[order]
    hits, lost = np.cumsum(w * ~g) / (w * ~g).sum(), np.cumsum(w * g) / (w * g).sum()
    last = np.r_[a[1:] != a[:-1], True]  # a cut only between different values
    ok = np.flatnonzero(last & (lost <= loss))
    if not len(ok):
        return float("inf")
    best = ok[np.argmax(hits[ok] - lost[ok])]
    return float((a[best] + (a[best + 1] if best + 1 < len(a) else a[best])) / 2) if best + 1 < len(a) else float(a[best]) - 1e-12


def table_threshold(judged: DataFrame, loss: float = LOSS, max_rows: int = MAX_ROWS) -> float:
    """:func:`threshold` of all rows of ``judged(anomaly, good, copies)``.  Up to ``max_rows`` distinct anomalies are compared on the
    driver, more by running totals, with the same result."""
    by = materialize(judged.groupBy("anomaly").agg(*[F.sum(F.when(F.col("good") == g, F.col("copies")).otherwise(0)).alias(c) for c, g in (("kept", True), ("hit", False))]), "anomalies")
    n, kept, hit = by.agg(F.count("*"), F.sum("kept"), F.sum("hit")).first()
    if not kept or not hit:
        return float("inf")
    if n <= max_rows:
        a, g, b = np.array(bounded_rows(by, max_rows, "anomalies")).T
        return threshold(np.r_[a, a], np.repeat([True, False], n), loss, np.r_[g, b].astype(np.int64))
    totals = running_totals(by, [F.col("anomaly").desc()], {"kept_above": F.col("kept"), "hit_above": F.col("hit")})
    hits, lost = (F.col("hit_above") + F.col("hit")) / F.lit(hit), (F.col("kept_above") + F.col("kept")) / F.lit(kept)
    best = totals.where(lost <= loss).orderBy((hits - lost).desc(), F.col("anomaly").desc()).first()
    if best is None:
        return float("inf")
    below = by.where(F.col("anomaly") < best.anomaly).agg(F.max("anomaly")).first()[0]
    return (best.anomaly + below) / 2 if below is not None else best.anomaly - 1e-12


def _features(b: pa.RecordBatch) -> np.ndarray:
    return features(np.stack([b.column(c).to_numpy() for c in STATS], 1)) if b.num_rows else np.empty((0, 3))


def _judge(forest: Forest | None, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(b)
            a = forest.anomaly(x) if forest and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a), pa.array(a > cut)], [*b.schema.names, "anomaly", "odd"])

    return run


def _judged(rows: DataFrame, forest: Forest | None, cut: float) -> DataFrame:
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", anomaly double, odd boolean"
    return rows.mapInArrow(_judge(forest, cut), kind)


def _counts(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, forest.first[-1]), np.int64)
        for b in batches:
            if b.num_rows:
                x, good = _features(b), b.column("good").to_numpy(zero_copy_only=False)
                total += forest.counts(x[good]), forest.counts(x[~good])
        leaf = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(total[0][leaf]), pa.array(total[1][leaf])], ["leaf", "good", "odd"])

    return run


def fit(learn: DataFrame, good: int, odd: int) -> Forest:
    """The forest of ``learn(id, STATS, good)``, distinct rows, ``good`` and ``odd`` of them."""
    # The rows that trees draw are told by their number in the order of id and statistics.
    key = ["id", *STATS]
    drawn = Forest.draw(good, odd)
    numbers = [np.unique(np.concatenate(d)) for d in zip(*drawn)]
    chosen = learn.sparkSession.createDataFrame(pa.table({"good": np.repeat([True, False], [len(n) for n in numbers]), "number": np.concatenate(numbers).astype(np.int64)}))
    placed = running_totals(learn.select(*key, "good"), [F.col(c) for c in key], {"good_before": F.col("good").cast("int"), "odd_before": (~F.col("good")).cast("int")})
    placed = placed.withColumn("number", F.when(F.col("good"), F.col("good_before")).otherwise(F.col("odd_before")))
    got = bounded_rows(placed.join(F.broadcast(chosen), ["good", "number"]).select("good", "number", *STATS), TREES * SAMPLE, "rows of the trees")
    rows = np.array(sorted(map(tuple, got)), np.int64).reshape(len(got), 2 + len(STATS))
    x = features(rows[:, 2:])
    own = rows[:, 0] == 1
    forest = Forest(x[own], x[~own], drawn=[tuple(np.searchsorted(n, d) for n, d in zip(numbers, both)) for both in drawn])
    counted = learn.mapInArrow(_counts(forest), "leaf long, good long, odd long").groupBy("leaf").agg(F.sum("good"), F.sum("odd"))
    leaf, *counts = np.array(bounded_rows(counted, TREES * SAMPLE, "leaves"), np.int64).T
    total = np.zeros((2, forest.first[-1]), np.int64)
    total[:, leaf] = counts
    forest.weigh(*total)
    return forest


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, carry: list[str] | None = None) -> DataFrame:
    """``row``, :data:`STATS`, ``base_failed``, ``anomaly``, ``kept`` for every row of ``docs(doc_id, text, ...)``;
    ``labels(doc_id, quality)`` with 1 for good.  ``max_rows``: see :func:`table_threshold`."""
    carry = carry or docs.columns
    stats = materialize(text_statistics(docs, sorted({*carry, "doc_id"})).withColumn("base_failed", base_failed()), "statistics")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("good"))
    # The forest speaks where the base rules don't, so it learns there.
    rows = materialize(
        stats.where(~F.col("base_failed")).withColumn("id", F.col("row.doc_id").cast("long")).join(known, "id", "left").groupBy("id", "good", *STATS).agg(F.count("*").alias("copies")), "labelled"
    )
    labelled = rows.where("good is not null").limit(1).count() > 0
    own = rows.where("good is not null") if labelled else rows
    own = own.withColumns({"good": F.coalesce(F.col("good") > 0, F.lit(True)), "held": F.pmod(F.xxhash64("id"), F.lit(4)) == 0})
    number = {(r.good, r.held): r["count"] for r in own.groupBy("good", "held").count().collect()}
    if not (number.get((True, True)) and number.get((False, True)) and number.get((True, False))):
        # too few rows to hold some out
        own = own.withColumn("held", F.lit(False))
        number = {(g, False): number.get((g, True), 0) + number.get((g, False), 0) for g in (True, False)}
    forest, cut = None, float("inf")
    if number.get((True, False)):
        forest = fit(own.where(~F.col("held")), number[True, False], number.get((False, False), 0))
        if labelled:
            judging = own.where("held") if number.get((True, True)) else own
            cut = table_threshold(_judged(judging, forest, cut), max_rows=max_rows)
    return _judged(stats, forest, cut).select("row", *STATS, "base_failed", "anomaly", (~F.col("base_failed") & ~F.col("odd")).alias("kept"))
