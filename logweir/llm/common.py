"""What the operators share: shared storage, word hashing, bounded broadcasts, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: White space that separates words, as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"

_MUL = np.uint64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------------------- shared storage
def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` if the session has it.  Without it only a local master may fall back to
    the warehouse folder (one machine); a cluster must name a shared folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under :func:`shared_dir`, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone; the folder's owner cleans it
            pass

    atexit.register(drop)
    return path


def arrow_uri(uri: str) -> str:
    """Arrow's name of a folder that Hadoop calls ``uri``: other schemes for object stores; ``dbfs:`` is mounted."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        return "s3:" + rest
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    return uri if "://" in uri or uri.startswith("file:") else "file://" + uri


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, for code in tasks."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet in shared storage and read it back: lineage ends there, and a lost
    executor costs only the tasks it was running."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``df`` with, for each of ``values``, the sum of that value over all rows before a row in the total ``order``.

    One range sort, written to shared storage; sums within a partition, and the partitions before it (a row a
    partition) on top.  No group meets in one task, whatever its size, if ``order`` tells its rows apart.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = df.withColumns({f"__value_{k}": v.cast("long") for k, v in values.items()})
    placed = wide.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The mark's upper bits are the partition's number, partitions are in order.
    placed = materialize(placed.withColumn("__mark", F.monotonically_increasing_id()), "sorted").withColumn("__part", F.shiftright("__mark", 33))
    sums = placed.groupBy("__part").agg(*[F.sum(f"__value_{k}").alias(f"__sum_{k}") for k in values])
    parts = sums.select("__part", *[(F.sum(f"__sum_{k}").over(Window.orderBy("__part")) - F.col(f"__sum_{k}")).alias(f"__before_{k}") for k in values])
    own = Window.partitionBy("__part").orderBy("__mark").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({k: F.coalesce(F.sum(f"__value_{k}").over(own), F.lit(0)) for k in values})
    out = inside.join(F.broadcast(parts), "__part")  # a row a partition
    return out.select(*df.columns, *[(F.col(f"__before_{k}") + F.col(k)).alias(k) for k in values])


def packed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row``, a struct of the columns in ``carry`` (all), and ``text`` unless ``row`` has it as a string, so that texts go to
    Python once; :func:`texts_of` finds them in a batch."""
    names = carry or docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    inside = "text" in names and docs.schema["text"].dataType.simpleString() == "string"
    return own.drop("text") if inside else own


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    names = batch.schema.names
    return batch.column("text") if "text" in names else batch.column("row").field("text")


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a constant of the plan, without Python workers; ``schema`` is DDL."""
    kind = StructType.fromDDL(schema)
    text = json.dumps([dict(zip(kind.names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<{kind.simpleString()}>")))


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a table whose size is proven: more than ``most`` rows is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise the bound or use the block form")
    return rows


# --------------------------------------------------------------------------- memory of tasks
def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow`` that leaves its worker small: workers live on through later stages, and what a task has freed counts
    as the executor's memory until the allocators give it back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 2 << 20) -> Iterator[None]:
    """Tables written inside go to Python in batches of about ``most`` bytes: Spark's own have 10,000 rows, whatever their texts' length up to
    64 MB, and the JVM and the worker hold each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


# --------------------------------------------------------------------------- hashing in tasks
def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values (wrap-around arithmetic is meant)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered for words seen before; starts over when full, so a
    task's memory doesn't follow the vocabulary."""

    MOST = 30_000  # as fast as more: the words that come often stay in the CPU's cache

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (order matters)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix64(h[:n] + _MUL)
        for i in range(1, k):
            out = mix64(out * _MUL + h[i : i + n])
    return out


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of ``text`` between white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words make one shingle, none makes none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows_hash(hashes.of(words), min(k, len(words))))


# --------------------------------------------------------------------------- components
def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Smallest reachable id of every id in ``edges``: columns ``id``, ``component_id``.

    Contraction: every vertex points at its least neighbour or itself, edges move to what their ends point at,
    and those that close are gone, so each round works on what the last one left.  "Least" is by id at
    first, which closes stars around their smallest member at once, then by a hash, which makes
    chains shrink by a constant factor a round.  Each round is written to shared storage.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    of = materialize(e.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    rounds = 0
    while e.limit(1).count():
        rank = (lambda c: F.struct(F.lit(0).cast("long").alias("h"), F.col(c).alias("id"))) if not rounds else (lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")))
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = materialize(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), "m")["id"].alias("p")), "pointers")
        moved = e.join(to, "u").select("v", F.col("p").alias("x")).join(to.select(F.col("u").alias("v"), F.col("p").alias("y")), "v")
        e = materialize(moved.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
        of = materialize(
            of.join(to.select(F.col("u").alias("label"), "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label")), "labels"
        )
        rounds += 1
    least = of.groupBy("label").agg(F.min("id").alias("component_id"))
    return of.join(least, "label").select("id", "component_id")
