"""Benchmark decontamination: which words of a document lie in a window of a benchmark item.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
The search is a set join with prefix filter, for containment 1:

1. every window is a list of overlapping shingles; one pass over all documents counts the items' shingles
   (and only those), which orders them by rarity;
2. full containment needs a prefix of one shingle per window, the rarest; documents probe those alone;
3. a probe that meets the shingle at word p, which stands at offset o in the window, fixes the only place
   where the window can stand, p - o; length and position bounds reject what doesn't fit the text;
4. the words of that place are compared one by one, so no hash decides a hit.

Items of up to ``BLOCK_WORDS`` words in all are sent to the tasks and the documents go past them in narrow passes; no document
is shuffled.  More items than that stay tables (:func:`joined`), in the same four steps: the documents go past a field of bits of
fixed size twice, whatever the number of items, and what it lets through meets the windows in an equality join on the
rarest shingle.

Defined cases: null, empty and wordless texts have no words and no hits; items with a null ``item_id`` or
without words are ignored; items that share an id count once; repeated documents are judged
row by row, very long ones whole; without items nothing is hit, without documents there is no row.  All input columns come back inside
the struct ``row``, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, bounded_rows, materialize, mix64, packed, texts_of, tidy, windows_hash

WINDOW, SHINGLE = 10, 5
#: Words of items that are sent to tasks, some 80 MB in each; more stay tables.
BLOCK_WORDS = 250_000
#: Bits of the field of shingles (16 MB) and of a piece of it, which is what ``bitmap_construct_agg`` makes.
FIELD_BITS, PIECE_BITS = 27, 15
#: Shingles that a task holds before it adds them up, windows and candidates in a batch.
HELD, BATCH = 1 << 20, 10_000

# Words are runs of 0-9, a-z (A-Z lower-cased) and code points from U+0080.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Windows:
    """The distinct windows of some items, as rows of word numbers; 0 is any other word."""

    def __init__(self, items: list[tuple[int, str]], window: int, shingle: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [number(w) for w in words_of(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                owners.setdefault(tuple(ids[i : i + n]), set()).add(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in owners:
            by_length.setdefault(len(w), []).append(w)
        #: length -> (rows of word numbers, items of each row, shingle hashes of each row)
        self.of = {}
        for n, rows in by_length.items():
            k, matrix = min(shingle, n), np.array(rows, np.int64)
            hashes = np.stack([windows_hash(self.hashed(r), k) for r in matrix])
            self.of[n] = (k, matrix, [sorted(owners[r]) for r in rows], hashes)

    @staticmethod
    def hashed(ids: np.ndarray) -> np.ndarray:
        return mix64(ids.astype(np.uint64))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)

    def shingles(self) -> dict[int, np.ndarray]:
        """Shingle length -> sorted distinct hashes."""
        found: dict[int, list[np.ndarray]] = {}
        for k, _, _, hashes in self.of.values():
            found.setdefault(k, []).append(hashes.ravel())
        return {k: np.unique(np.concatenate(v)) for k, v in found.items()}


class Probe:
    """Windows indexed by their rarest shingle."""

    def __init__(self, windows: Windows, counts: dict[int, int]) -> None:
        self.windows, self.parts = windows, []
        for n, (k, matrix, items, hashes) in windows.of.items():
            seen = np.array([[counts.get(int(h), 0) for h in row.view(np.int64)] for row in hashes])
            offset = seen.argmin(1)
            key = hashes[np.arange(len(hashes)), offset]
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.parts.append((n, k, matrix, items, keys, np.r_[first, len(order)], order, offset))

    def hits(self, ids: np.ndarray, hit: np.ndarray, items: set[int]) -> None:
        """Mark the hit words of a document and gather the items."""
        hashed: dict[int, np.ndarray] = {}
        for n, k, matrix, owners, keys, first, order, offset in self.parts:
            if len(ids) < n:  # length bound
                continue
            if k not in hashed:
                hashed[k] = windows_hash(Windows.hashed(ids), k)
            at = np.searchsorted(keys, hashed[k])
            at[at == len(keys)] = 0
            place = np.flatnonzero(keys[at] == hashed[k])
            if not len(place):
                continue
            many = first[at[place] + 1] - first[at[place]]
            inside = np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
            row = order[np.repeat(first[at[place]], many) + inside]
            start = np.repeat(place, many) - offset[row]
            fits = (start >= 0) & (start + n <= len(ids))  # position bounds
            row, start = row[fits], start[fits]
            same = (ids[start[:, None] + np.arange(n)] == matrix[row]).all(1)
            row, start = row[same], start[same]
            for i in range(n):
                hit[start + i] = True
            for r in np.unique(row):
                items.update(owners[r])


def _count(own: Windows) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = own.shingles()
        totals = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
        for b in batches:
            for text in b.column(0):
                ids = own.numbers(words_of(text.as_py()))
                if not ids.any():
                    continue
                hashed = Windows.hashed(ids)
                for k, keys in wanted.items():
                    h = windows_hash(hashed, k)
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    totals[k] += np.bincount(at[keys[at] == h], minlength=len(keys))
        for k, keys in wanted.items():
            some = totals[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(totals[k][some])], ["shingle", "n"])

    return run


def _probe(own: Probe) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                lengths, starts, ends, items = [], [], [], []
                for text, s, e, known in zip(texts_of(part), *(part.column(c) for c in ("starts", "ends", "item_ids"))):
                    ids = own.windows.numbers(words_of(text.as_py()))
                    hit = np.zeros(len(ids) + 2, bool)
                    for p, q in zip(s.as_py() or (), e.as_py() or ()):
                        hit[p + 1 : q + 1] = True
                    found = set(known.as_py() or ())
                    if ids.any():
                        own.hits(ids, hit[1:-1], found)
                    edge = np.flatnonzero(hit[1:] != hit[:-1]).astype(np.int32)
                    lengths.append(len(ids)), starts.append(edge[::2]), ends.append(edge[1::2]), items.append(sorted(found))
                ints = pa.list_(pa.int32())
                same = [c for c in ("row", "text") if c in part.schema.names]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, same), pa.array(lengths, pa.int64()), pa.array(starts, ints), pa.array(ends, ints), pa.array(items, pa.list_(pa.int64()))],
                    [*same, "n_words", "starts", "ends", "item_ids"],
                )

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """``row, n_words, starts, ends, item_ids`` for every row of ``docs(text, ...)``.

    ``row`` has the document's columns (those in ``carry``), ``starts``/``ends`` the hit runs of words (end exclusive) and
    ``item_ids`` the ids of ``items(item_id, text)`` with a window in the text.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    words = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    if words > BLOCK_WORDS:
        return joined(docs, items, window, shingle, carry)
    text = F.col("text").cast("string")
    out = packed(docs, carry).select(
        "*", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<long>").alias("item_ids"),
    )
    windows = Windows([(r.item_id, r.text) for r in items.collect()], window, shingle)  # a row has a word or more in the sum above
    counted = docs.select(text).mapInArrow(tidy(_count(windows)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = {r.shingle: r.n for r in counted.collect()}  # at most the items' own shingles
    return out.mapInArrow(tidy(_probe(Probe(windows, counts))), out.schema).drop("text")


# --------------------------------------------------------------------------- items of any number
def _keys(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of each shingle of ``k`` words; shingles of another length have other hashes."""
    return windows_hash(hashed, k) ^ np.uint64(k)


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                n = min(window, len(words))
                if not n:
                    continue
                k = min(shingle, n)
                keys = _keys(hashes.of(words), k).view(np.int64)
                for lo in range(0, len(words) - n + 1, BATCH):
                    at = range(lo, min(lo + BATCH, len(words) - n + 1))
                    rows = [b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass") for i in at]
                    own = [keys[i : i + n - k + 1] for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(rows), pa.int64()), pa.array(rows), pa.array([n] * len(rows), pa.int32()), pa.array([k] * len(rows), pa.int32()), pa.array(own, pa.list_(pa.int64()))],
                        ["item_id", "words", "n", "k", "keys"],
                    )

    return run


def _field(keys: DataFrame):
    """A broadcast field with the bit of each of ``keys(key)``, of one size whatever their number."""
    bit = F.shiftrightunsigned("key", 64 - FIELD_BITS) + 1
    pieces = keys.groupBy(F.bitmap_bucket_number(bit).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    field, each = np.zeros(1 << FIELD_BITS - 3, np.uint8), 1 << PIECE_BITS - 3
    for r in bounded_rows(pieces, 1 << FIELD_BITS - PIECE_BITS, "the field of shingles"):
        field[(r.piece - 1) * each : r.piece * each] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(field)


def _inside(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - FIELD_BITS)).astype(np.int64)
    return np.flatnonzero(field[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def _count_keys(shared, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        for b in batches:
            for text in b.column(0):
                hashed = hashes.of(words_of(text.as_py()))
                for k in lengths:
                    keys = _keys(hashed, k)
                    held.append(keys[_inside(shared.value, keys)])
                    size += len(held[-1])
                if size >= HELD or len(held) >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _candidates(shared, lengths: list[int], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        rows: list[tuple[str, int, int, int, str]] = []
        names = ["digest", "key", "at", "before", "around"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                words, digest = words_of(text), None
                hashed = hashes.of(words)
                for k in lengths:
                    keys = _keys(hashed, k)
                    for at in _inside(shared.value, keys).tolist():
                        digest = digest or hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                        first = max(0, at - window + k)
                        around = b" ".join(words[first : at + window]).decode("utf-8", "surrogatepass")
                        rows.append((digest, int(keys[at].view(np.int64)), at, at - first, around))
                        if len(rows) >= BATCH:
                            yield flush()
                            rows.clear()
        if rows:
            yield flush()

    return run


def joined(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """:func:`contamination` for items of any number: windows stay a table under their rarest shingle.

    Two passes over the documents, of one Python stage each.  What the tasks keep of the items' shingles is one bit each in a field of
    fixed size; shingles that share a bit only let more through to the join.  Documents with equal texts are searched once from the join on.
    """
    text = F.col("text").cast("string")
    texts = docs.where(text.isNotNull()).select(text.alias("text"))
    made = "item_id long, words string, n int, k int, keys array<long>"
    windows = materialize(items.select("item_id", "text").mapInArrow(_item_windows(window, shingle), made), "windows")
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())  # at most ``shingle``
    own = windows.groupBy("words").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    each = materialize(own.select("words", "n", F.size("keys").alias("many"), F.posexplode("keys").alias("offset", "key")), "shingles")

    counted = texts.mapInArrow(tidy(_count_keys(_field(each), lengths)), "key long, n long")
    counts = counted.groupBy("key").agg(F.sum("n").alias("seen"))
    # A window with a shingle that no document has stands nowhere.
    rarest = F.min_by(F.struct("key", "offset"), F.struct("seen", "offset")).alias("rarest")
    probes = each.join(counts, "key").groupBy("words", "n", "many").agg(F.count("*").alias("found"), rarest).where("found = many")
    probes = materialize(probes.select("words", "n", "rarest.key", "rarest.offset"), "probes")

    candidates = texts.mapInArrow(tidy(_candidates(_field(probes), lengths, window)), "digest string, key long, at int, before int, around string").distinct()
    first = F.col("before") - F.col("offset")  # negative: the window would begin before the text
    stands = F.array_join(F.slice(F.split("around", " "), F.greatest(first, F.lit(0)) + 1, F.col("n")), " ")
    start = F.col("at") - F.col("offset")
    hits = candidates.join(probes, "key").where((first >= 0) & (stands == F.col("words")))
    hits = materialize(hits.select("digest", start.alias("start"), (start + F.col("n")).alias("end"), "words"), "hits")

    # Runs of hit words: a new one begins behind the end of all before it.  A window's group is one text.
    of_text = Window.partitionBy("digest").orderBy("start")
    reach = F.max("end").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.groupBy("digest", "start").agg(F.max("end").alias("end"))
    spans = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(of_text))
    runs = spans.groupBy("digest", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    named = hits.select("digest", "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
    named = named.groupBy("digest").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))

    n_words = F.coalesce(F.regexp_count(text, F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), n_words.alias("n_words"), F.sha2(text, 256).alias("digest"))
    none = lambda column, kind: F.coalesce(column, F.array().cast(f"array<{kind}>"))
    return rows.join(runs.join(named, "digest"), "digest", "left").select(
        "row", "n_words", none(F.col("runs.start"), "int").alias("starts"), none(F.col("runs.end"), "int").alias("ends"), none(F.col("item_ids"), "long").alias("item_ids")
    )


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from :func:`contamination`."""
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + (x["ends"] - x["starts"]))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "row.doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
