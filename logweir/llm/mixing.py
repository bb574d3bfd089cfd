"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets.  Sources in code point order, null last, get the weights ``WEIGHTS`` in turn.  They share all words by
weight; no target exceeds ``MOST`` times its source, and what a source can't take is shared again by weight
until none is above.  The fixed point has a closed form: in the order of MOST * size / weight the capped sources come first.

Curriculum.  A source's weight over training time t in [0, 1] is its target times 1 + g (2 t - 1), where the slope g
takes the values ``SLOPES`` in turn (falling, steady, rising).  Its integral, the cumulative demand, is
t + g (t^2 - t); a document that starts after the share u of its source's taken words gets the time
t with demand u, a root of a quadratic.

Choice.  A source of size s and target T is taken floor(T / s) times whole; the rest, the gap, goes to passes over its
documents that are not longer than what is still missing.  In the order of a digest of id and text the first pass takes documents up
to the first that doesn't fit; later passes do so in the order of larger powers of two first, then the digest.  They end when no
document left fits, after two passes a power of two at most: what a source misses in the end is less than its
smallest document left.  Documents are taken whole, ``MOST`` times at most.

Order.  All occurrences are range-sorted by their training time (ties by the digest, then the epoch) and numbered from 0 on:
``rank`` is the place in the training data.

Running totals (within a source, over sources, ranks) come from one range sort each and a total per partition
(:func:`..common.running_totals`), so neither a hot source nor a large number of sources meets in one task.

Defined cases: null and empty texts have size 0 and are never taken (a copy of nothing has no words); a null source is a source of its own;
rows equal in id and text are interchangeable; very long texts count in full; sources of size 0 get the target 0; an empty table gives an
empty mix; other columns don't matter, whatever their names.  Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, running_totals

WEIGHTS, SLOPES, MOST = (1, 2, 3), (-0.5, 0.0, 0.5), 3


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def _mark(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def order_key(doc_id: Column, mark: Column) -> Column:
    """Digest that orders the documents of a source."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), mark).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, slope, target`` from ``source, source_size`` (one row a source)."""
    numbered = running_totals(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"at": F.lit(1)})
    turn = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("at") % len(values) + 1).cast("int"))
    named = numbered.select("source", "source_size", turn(WEIGHTS).cast("long").alias("weight"), turn(SLOPES).alias("slope"), "at", (F.lit(MOST) * F.col("source_size")).alias("cap"))
    before = running_totals(named, [F.col("cap") / F.col("weight"), F.col("at")], {"caps": F.col("cap"), "weights": F.col("weight")})
    sums = before.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of longs may not fit into a long
    # A source is capped if its cap is not above its share of what the sources before it left.
    capped = before.withColumn("capped", whole(F.col("cap")) * whole(F.lit(sums.weight or 0) - F.col("weights")) <= whole(F.col("weight")) * whole(F.lit(sums.size or 0) - F.col("caps")))
    capped = materialize(capped, "capped")
    done = capped.where("capped").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    left, free = (sums.size or 0) - (done.cap or 0), (sums.weight or 0) - (done.weight or 0)
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(free or 1))
    return capped.select("source", "source_size", "weight", "slope", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def position(u: Column, slope: Column) -> Column:
    """Training time at which the cumulative demand t + g (t^2 - t) reaches ``u``."""
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope)
    return F.when((slope == 0) | (u == 0), u).otherwise(root)


def _named(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``by_source(source, ...)``, null sources included; a hot source is split by the join."""
    other = by_source.withColumnRenamed("source", "other_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("other_source")), how).drop("other_source")


def _within_source(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the source that come before."""
    placed = running_totals(rows, [F.col("source").asc_nulls_last(), *order], {name: F.col(value)})
    return _named(placed, placed.groupBy("source").agg(F.min(name).alias("start"))).withColumn(name, F.col(name) - F.col("start")).drop("start")


def choose(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, source, mark, digest, size, source_size, target, positions`` for every row of ``docs(doc_id, text, source, ...)``:
    ``positions`` has a training time in [0, 1] for each time the document is taken, ``mark`` is the text's digest."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _mark(F.col("text")).alias("mark"))
    base = materialize(base.select(F.monotonically_increasing_id().alias("rid"), "*", order_key(F.col("doc_id"), F.col("mark")).alias("digest")), "mixing")
    goal = materialize(targets(materialize(base.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")), "targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    # Rounded to whole words; a target of an exact multiple leaves nothing.
    gap = F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long")
    goal = goal.withColumn("full", full).withColumn("gap", gap)
    rows = materialize(_within_source(base, [F.col("digest"), F.col("rid")], "size", "c"), "ordered")

    picked = _fill(rows.where("size > 0").select("rid", "source", "size", "digest"), goal.select("source", "gap"))
    rows = _named(rows, goal).join(picked, "rid", "left")
    times = F.when(F.col("size") > 0, F.col("full") + F.col("lead").isNotNull().cast("int")).otherwise(F.lit(0)).cast("int")
    # Epoch e of a document starts after e whole passes and the documents before it; the last one of a picked document after those picked before it.
    ahead = lambda e: F.when(e == F.col("full"), F.coalesce("lead", "c")).otherwise(F.col("c"))
    start = lambda e: F.least(F.lit(1.0), (e * F.col("source_size") + ahead(e)) / F.greatest(F.col("target"), F.lit(1.0)))
    epochs = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    positions = F.transform(epochs, lambda e: position(start(e), F.col("slope")))
    return rows.select("rid", "doc_id", "source", "mark", "digest", "size", "source_size", "target", positions.alias("positions"))


def _fill(free: DataFrame, gaps: DataFrame) -> DataFrame:
    """``rid, lead`` of the documents that fill the gaps; ``lead``: words picked before it."""
    missing = materialize(gaps.select("source", "gap", F.col("gap").alias("missing")), "missing")
    picked: DataFrame | None = None
    while True:
        fits = _named(free, missing).where("size <= missing")
        larger_first = [] if picked is None else [F.length(F.bin("size")).desc()]
        dealt = _within_source(fits, [*larger_first, F.col("digest"), F.col("rid")], "size", "c")
        dealt = materialize(dealt.withColumn("chosen", F.col("c") + F.col("size") <= F.col("missing")), "pass")
        own = dealt.where("chosen").select("rid", (F.col("gap") - F.col("missing") + F.col("c")).alias("lead"))
        if picked is not None and own.isEmpty():
            return picked
        picked = own if picked is None else picked.unionByName(own)
        took = dealt.where("chosen").groupBy("source").agg(F.sum("size").alias("took"))
        missing = materialize(_named(missing, took, "left").select("source", "gap", (F.col("missing") - F.coalesce("took", F.lit(0))).alias("missing")), "missing")
        free = dealt.where(~F.col("chosen")).select("rid", "source", "size", "digest")


def ranked(chosen: DataFrame) -> DataFrame:
    """A row for each time a document is taken, from :func:`choose`: ``rid, doc_id, mark, size, epoch, position, rank``."""
    each = chosen.select("rid", "doc_id", "mark", "size", "digest", F.posexplode("positions").alias("epoch", "position"))
    order = [F.col("position"), F.col("digest"), F.col("epoch"), F.col("rid")]
    return running_totals(each, order, {"rank": F.lit(1)}).drop("digest")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, source, mark, size, source_size, target, taken, position, ranks`` for every row of ``docs(doc_id, text, source, ...)``.

    ``ranks`` are the places of the document in the range-sorted mix, comma-joined, ``position`` its first training time (null if
    it isn't taken), ``taken`` the words of all its occurrences.
    """
    chosen = materialize(choose(docs), "chosen")
    own = ranked(chosen).groupBy("rid").agg(
        F.sum("size").alias("taken"), F.min("position").alias("position"),
        F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda r: r.cast("string")), ",").alias("ranks"),  # MOST at most
    )
    return chosen.join(own, "rid", "left").select(
        "doc_id", "source", "mark", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position", F.coalesce("ranks", F.lit("")).alias("ranks")
    )


def occurrences(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mix as training data: the columns of ``docs``, a row for each time a document is taken, range-sorted by rank.

    Texts move twice, to their ranks and to their place; rows equal in id and text are interchangeable, so that one of them (the
    least by a hash of all columns) stands for all their occurrences.
    """
    taken = ranked(choose(docs)).select(F.col("doc_id").alias("k"), F.col("mark").alias("m"), "rank")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("h"), F.col("doc_id").alias("k"), _mark(F.col("text")).alias("m"))
    one = packed.groupBy("k", "m").agg(F.min_by("row", "h").alias("row")).withColumnsRenamed({"k": "k2", "m": "m2"})
    placed = taken.join(one, F.col("k").eqNullSafe(F.col("k2")) & (F.col("m") == F.col("m2"))).select("rank", "row")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "rank").sortWithinPartitions("rank").select("row.*")
