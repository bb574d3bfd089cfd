"""Token-id shards with a minimal perfect hash index.

Files (all little-endian, written under a folder that the cluster shares):

* a shard: ``TIDS`` + item size (2 bytes an id if every id fits, else 4), raw ids of its documents one after the
  other in ascending ``doc_id`` order, then a directory (doc ids, null marks, id counts), and its length.
  Shards ascend too: ids come from a range sort, so any document's place follows from the counts before it;
* an index part, for a hash share of the keys: a minimal perfect hash of the BBHash kind (levels of bit
  arrays with gamma 2; a key takes the first level where it is alone; rank = its slot) and per slot a stored
  32-bit fingerprint, shard number, offset and count.  A lookup reads a bounded number of words
  whatever the number of keys, and a key that was never stored fails the fingerprint but for 2^-32.

Every attempt of a task writes a file of its own; the manifest, a table in shared storage, names those of the
attempts that Spark committed, so a lost executor leaves at most files that nothing refers to.

Defined cases: null and empty texts are stored as the end id alone.  Documents with a null ``doc_id``
come last; they are in the shards, not in the index.  Repeated ids are stored each; the index points at
the first of them.  An empty table makes an empty manifest.  Other columns are not stored.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, mix64, new_dir, open_folder, small_batches, tidy

END_ID, MAGIC = 2, b"TIDS"
KEYS_PER_PART = 200_000
#: Bytes of text that are encoded at once.
RUN = 1 << 20
PUNCTUATION = ".,!?;:*&%$#|()"


# --------------------------------------------------------------------------- encoding
class Encoder:
    """Byte-level BPE over slices of texts, with remembered pieces.

    A pre-token begins at every single space before a character that is no white space, so a text's ids are
    those of its pieces cut there, and pieces repeat: a slice is cut by Arrow, its distinct pieces are looked up,
    the new ones go through the tokenizer many at a time, and the ids of all pieces are gathered.  A trailing run of
    plain punctuation after a letter or digit is a pre-token of its own too.

    New pieces without white space are encoded as one text: each of them begins with a space, and only the first id of
    such a piece has one, which tells where it starts.  Where the count of starts differs from that of the
    pieces they are encoded one by one.
    """

    MOST_PIECES, LONGEST, JOINED, AT_ONCE = 300_000, 64, 64, 2_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # what comes again is remembered here
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("\u0120")  # how the vocabulary writes a space
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.pool = np.empty(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)

    def _shrink(self) -> None:
        """Keep the pieces that came again since the last time, most of which come often; the others make room."""
        again = self.again[: len(self.known)]
        if 2 * again.sum() > self.MOST_PIECES:
            return self._forget()
        code, words = np.flatnonzero(again), list(compress(self.known, again.tolist()))  # pieces are in the order of their codes
        n = self.size[code]
        ids = gathered(self.pool, self.first[code], n)
        self._forget()
        self._add(words, ids, n)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's."""
        flat, n = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(texts), self.AT_ONCE):  # what the tokenizer returns is large
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + self.AT_ONCE], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32)), n.append(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate(flat), np.concatenate(n)

    @staticmethod
    def _grown(a: np.ndarray, least: int) -> np.ndarray:
        return a if len(a) >= least else np.resize(a, max(least, 2 * len(a)))

    def _add(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        at, end = len(self.known), len(self.known) + len(words)
        self.pool = self._grown(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first, self.size, self.again = (self._grown(a, end) for a in (self.first, self.size, self.again))
        self.again[at:end] = False
        self.first[at:end] = self.used + np.cumsum(n) - n
        self.size[at:end] = n
        self.used += len(ids)
        self.known.update(zip(words, range(at, end)))

    def _learn(self, simple: list[str], words: list[str]) -> None:
        """Remember words, each as a piece that follows a space: ``simple`` ones of letters and digits, and others.  A word's tail, plain
        punctuation at its end or all from its first white space on, is a pre-token boundary away from its head; tails are
        remembered behind a line break."""
        plain, odd, cuts, tails, todo = dict.fromkeys(simple), {}, ([], []), {}, list(words)
        for w in todo:  # grows by heads
            if space := self._space.search(w):
                head = w[: space.start()]
            elif w[-1] in PUNCTUATION and (head := w.rstrip(PUNCTUATION)) and head[-1].isalnum():
                pass
            else:
                (odd if "<|" in w or not w.isprintable() else plain)[w] = None
                continue
            tail = "\n" + w[len(head) :]
            cuts[space is not None].append((w, head, tail))
            if tail not in self.known:
                tails[tail] = None
            if head not in self.known:
                todo.append(head)
        self._add(list(odd), *self.ids([" " + w for w in odd]))
        self._add(list(tails), *self.ids([t[1:] for t in tails]))
        todo = list(plain)
        for at in range(0, len(todo), 64 * self.JOINED):
            part = todo[at : at + 64 * self.JOINED]
            ids, n = self.ids([" " + " ".join(part[i : i + self.JOINED]) for i in range(0, len(part), self.JOINED)])
            starts = np.flatnonzero(self.opens[ids])
            begins = np.cumsum(n) - n
            expected = np.minimum(self.JOINED, len(part) - self.JOINED * np.arange(len(n)))
            if len(starts) == len(part) and (np.diff(np.searchsorted(starts, np.r_[begins, len(ids)])) == expected).all():
                self._add(part, ids, np.diff(np.r_[starts, len(ids)]))
            else:
                self._add(part, *self.ids([" " + w for w in part]))
        for cut in cuts:  # heads before what they are heads of
            cut = list({w: (w, h, t) for w, h, t in cut if w not in self.known}.values())
            code = np.array([(self.known[h], self.known[t]) for _, h, t in cut], np.int64).reshape(-1)
            n = self.size[code]
            self._add([w for w, _, _ in cut], gathered(self.pool, self.first[code], n), n.reshape(-1, 2).sum(1))

    _space = re.compile(r"\s")
    # A space before white space or the end is no cut; the class is wider than the tokenizer's white space.
    _odd = r" ([\s\x0B\x1C-\x1F\x{85}\p{Z}]|\z)"

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        odd = pc.match_substring_regex(texts, self._odd)
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " ")
        where = odd.to_numpy(zero_copy_only=False)
        cut = pa.array([re.split(r" (?=\S)", t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        order = np.empty(len(texts), np.int64)
        order[~where], order[where] = np.arange((~where).sum()), (~where).sum() + np.arange(where.sum())
        return pa.concat_arrays([pc.split_pattern(texts.filter(pc.invert(odd)), " "), cut]).take(pa.array(order))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after the other, ``end_id`` behind each text, and the number of ids of each text."""
        if len(self.known) > self.MOST_PIECES:
            self._shrink()
        lists = self._pieces(texts.fill_null(""))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        opening = of[offsets[:-1]]  # a text's first piece has no space before it
        later = np.bincount(of, minlength=len(words)) > np.bincount(opening, minlength=len(words))
        code = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = later & (code < 0)
        self.again[code[code >= 0]] = True
        long = new & (pc.binary_length(coded.dictionary).to_numpy() > self.LONGEST)  # not worth remembering
        simple = pc.utf8_is_alnum(coded.dictionary).to_numpy(zero_copy_only=False)
        pick = lambda mask: list(compress(words, mask.tolist()))
        new &= ~long
        self._learn(pick(new & simple), pick(new & ~simple))
        code[new] = [self.known[w] for w in pick(new)]
        heads, far = np.unique(opening), np.flatnonzero(long)
        own, n_own = self.ids([words[i] for i in heads.tolist()] + [" " + words[i] for i in far.tolist()])
        pool = np.concatenate([self.pool[: self.used], own, np.array([end_id], np.uint32)])
        n_own = np.r_[n_own, 1]
        first, size = np.r_[self.first[code], self.used + np.cumsum(n_own) - n_own], np.r_[self.size[code], n_own]
        first[far], size[far] = first[len(words) + len(heads) : -1], n_own[len(heads) : -1]
        # The pieces of each text, its first one from the heads, and the end id behind them.
        pieces = np.full(len(of) + len(texts), len(first) - 1, np.int64)
        pieces[np.arange(len(of)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = of
        start = offsets[:-1] + np.arange(len(texts))
        pieces[start] = len(words) + np.searchsorted(heads, opening)
        n = size[pieces]
        return gathered(pool, first[pieces], n), np.add.reduceat(n, start)


def gathered(pool: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``n`` values of ``pool`` from ``first`` on, one after the other."""
    before = np.cumsum(n) - n
    return pool[np.repeat(first - before, n) + np.arange(int(n.sum()))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder: a worker runs many tasks, and the pieces of one come again in the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Start and end of runs of texts with some ``most`` bytes; a longer text is a run by itself."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
        yield at, (end := max(end, at + 1))
        at = end


# --------------------------------------------------------------------------- files
ENTRY = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
])


def _write(path: str, out_dir: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stream, name, part = None, None, "", TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            if stream is None:
                own = encoder(path)
                fs, folder = open_folder(out_dir)
                fs.create_dir(folder, recursive=True)
                name = f"shard-{part:06d}-{uuid.uuid4().hex}.tok"
                stream = fs.open_output_stream(f"{folder}/{name}")
                stream.write(MAGIC + struct.pack("<I", size))
            for lo, hi in slices(b.column(1), RUN):
                found, n = own.encode(b.column(1).slice(lo, hi - lo), end_id)
                stream.write(found.astype("<u2" if size == 2 else "<u4").tobytes())
                key, rows = b.column(0).slice(lo, hi - lo), hi - lo
                ids.append(key.fill_null(0).to_numpy()), nulls.append(key.is_null().to_numpy(zero_copy_only=False)), counts.append(n)
                offset = at + np.r_[0, np.cumsum(n)[:-1]]
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(rows, part, "i4")), pa.array([name] * rows), pa.array(offset), pa.array(n)], ENTRY.names)
        if stream is not None:
            for column, kind in ((ids, "<i8"), (nulls, "u1"), (counts, "<i8")):
                stream.write(np.concatenate(column).astype(kind).tobytes())
            stream.write(struct.pack("<QQ", sum(map(len, counts)), at))
            stream.close()

    return run


def _stable(df: DataFrame) -> bool:
    """Whether a task of ``df`` that runs again gives its rows in the same order: no shuffle and no RDD in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" not in plan and "RDD" not in plan


def write_shards(docs: DataFrame, tokenizer_path: str, out_dir: str, shards: int | None = None, end_id: int = END_ID, distinct: bool = False) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into shards under ``out_dir``; returns the manifest
    ``doc_id, part, file, offset, n_tokens`` (offset in ids within the shard), already written.

    Rows that are equal are spread over shards like others; ``distinct`` says that no two rows have an id in common."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    shards = shards or _partitions(docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    if not distinct:
        # Equal rows need a mark, or one that is repeated all over would fill a shard.  Which of them has which is all the same, but
        # a task that runs again must give the same: behind a shuffle rows may come in another order.
        text = (text if _stable(text) else materialize(text, "texts")).withColumn("row", F.monotonically_increasing_id())
        order.append(F.col("row"))
    placed = text.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    placed = placed.select("doc_id", "text")
    write = tidy(_write(tokenizer_path, out_dir, end_id, 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4))
    with small_batches(spark):
        return materialize(placed.mapInArrow(write, ENTRY), "manifest")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, rank by counts before each word."""

    def __init__(self, levels: list[np.ndarray], before: list[np.ndarray]) -> None:
        self.levels, self.before = levels, before

    @staticmethod
    def place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix64(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, before, rank = [], [], 0
        while len(keys):
            bits = max(64, int(gamma * len(keys)) + 63 & ~63)
            at = cls.place(keys, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            levels.append(words), before.append(rank + np.r_[0, np.cumsum(counts)[:-1]])
            rank += int(counts.sum())
            keys = keys[~alone[at]]
        return cls(levels, before)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if no level holds it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = self.place(keys[left], level, len(words) * 64)
            bit, word = (at & 63).astype(np.uint64), words[at >> 6]
            on = (word >> bit & np.uint64(1)).astype(bool)
            low = word[on] & ((np.uint64(1) << bit[on]) - np.uint64(1))
            out[left[on]] = before[at[on] >> 6] + np.bitwise_count(low).astype(np.int64)
            left = left[~on]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


def _index(out_dir: str):
    def run(table: pa.Table) -> pa.Table:
        keys = table["doc_id"].to_numpy().view(np.uint64)
        perfect = PerfectHash.build(keys)
        slot = perfect.slots(keys)
        put = lambda v, kind: (lambda a: (a.__setitem__(slot, v), a)[1])(np.zeros(len(keys), kind))
        body = {"marks": put(fingerprint(keys), "u4"), "part": put(table["part"].to_numpy(), "i4"), "offset": put(table["offset"].to_numpy(), "i8"), "n": put(table["n_tokens"].to_numpy(), "i8")}
        body |= {f"l{i}": x for i, x in enumerate(perfect.levels)} | {f"b{i}": x for i, x in enumerate(perfect.before)}
        np.savez(buffer := io.BytesIO(), **body)
        fs, folder = open_folder(out_dir)
        name = f"index-{table['share'][0].as_py():06d}-{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(f"{folder}/{name}") as f:
            f.write(buffer.getvalue())
        return pa.table({"share": table["share"][:1], "index": pa.array([name])})

    return run


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def share_of(key, shares: int):
    return F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")


def build_index(manifest: DataFrame, out_dir: str, keys_per_part: int = KEYS_PER_PART) -> DataFrame:
    """Index parts over the manifest's keys: ``share, index, shares``; a share has about ``keys_per_part`` keys."""
    keys = manifest.where("doc_id is not null")
    shares = max(1, -(-keys.count() // keys_per_part))
    least = keys.groupBy("doc_id").agg(F.min_by(F.struct("part", "offset", "n_tokens"), F.struct("part", "offset")).alias("at"))
    files = least.select("doc_id", "at.*", share_of("doc_id", shares).alias("share")).groupBy("share").applyInArrow(_index(out_dir), "share int, index string")
    return materialize(files.withColumn("shares", F.lit(shares)), "index")


def _lookup(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, PerfectHash | None, dict] = ("", None, {})
        for b in batches:
            keys, names = b.column(0).to_numpy().view(np.uint64), b.column(1).to_pylist()
            part, offset, n = (np.full(len(keys), -1, k) for k in ("i4", "i8", "i8"))
            for name in dict.fromkeys(names):  # sorted by file, so few per batch
                if name != held[0]:
                    fs, folder = open_folder(out_dir)
                    with fs.open_input_file(f"{folder}/{name}") as f:
                        body = dict(np.load(io.BytesIO(f.read())))
                    k = sum(x[0] == "l" for x in body)
                    held = (name, PerfectHash([body[f"l{i}"] for i in range(k)], [body[f"b{i}"] for i in range(k)]), body)
                own = np.flatnonzero(np.array([x == name for x in names]))
                slot = held[1].slots(keys[own])
                known = slot >= 0
                known[known] = held[2]["marks"][slot[known]] == fingerprint(keys[own][known])
                for out, field in ((part, "part"), (offset, "offset"), (n, "n")):
                    out[own[known]] = held[2][field][slot[known]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part), pa.array(offset), pa.array(n)], ["doc_id", "part", "offset", "n_tokens"])

    return run


def lookup(keys: DataFrame, index: DataFrame, out_dir: str) -> DataFrame:
    """``doc_id, part, offset, n_tokens`` for each row of ``keys(doc_id)`` through the index; part -1: not stored."""
    first = index.select("shares").first()
    if first is None:
        return keys.where("doc_id is not null").select("doc_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("offset"), F.lit(-1).cast("long").alias("n_tokens"))
    named = keys.where("doc_id is not null").select("doc_id", share_of("doc_id", first.shares).alias("share")).join(index.select("share", "index"), "share")
    dealt = named.select("doc_id", "index").repartition(_partitions(keys), F.col("index"), F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    return dealt.sortWithinPartitions("index").mapInArrow(_lookup(out_dir), "doc_id long, part int, offset long, n_tokens long")


def _directory(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(out_dir)
        for b in batches:
            for part, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    end = f.size()
                    docs, _ = struct.unpack("<QQ", f.read_at(16, end - 16))
                    raw = f.read_at(17 * docs, end - 16 - 17 * docs)
                ids = np.frombuffer(raw, "<i8", docs)
                null = np.frombuffer(raw, "u1", docs, 8 * docs).astype(bool)
                n = np.frombuffer(raw, "<i8", docs, 9 * docs)
                offset = np.r_[0, np.cumsum(n)[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(np.full(docs, part, "i4")), pa.array([name] * docs), pa.array(offset), pa.array(n)], ENTRY.names)

    return run


def read_directory(shards: DataFrame, out_dir: str) -> DataFrame:
    """Every stored document, from the shards' own directories; ``shards`` has ``part, file``."""
    # Ranges with a number of partitions, or a small table of names would end in one task.
    n = max(1, min(_partitions(shards), shards.count()))
    dealt = shards.select("part", "file").repartitionByRange(n, "file")
    return dealt.mapInArrow(_directory(out_dir), ENTRY)


#: A read covers documents that stand one behind the other, this many bytes of them.
RUN_BYTES = 8 << 20


def _runs(names: list[str], offset: np.ndarray, n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Start and end of rows that are neighbours in one file, up to ``most`` ids (a longer document is a run by itself)."""
    at = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[at] or offset[i] != offset[i - 1] + n[i - 1] or offset[i] + n[i] - offset[at] > most:
            yield at, i
            at = i


def _payload(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, f, size = "", None, 0
        fs, folder = open_folder(out_dir)
        try:
            for b in batches:
                crc: list[int] = []
                names = b.column("file").to_pylist()
                offset, n = (b.column(c).to_numpy() for c in ("offset", "n_tokens"))
                for lo, hi in _runs(names, offset, n, RUN_BYTES // 4):
                    if names[lo] != held:
                        if f is not None:
                            f.close()
                        held, f = names[lo], fs.open_input_file(f"{folder}/{names[lo]}")
                        magic, size = struct.unpack("<4sI", f.read_at(8, 0))
                        if magic != MAGIC:
                            raise ValueError(f"{held} is no token shard")
                    total = int(n[lo:hi].sum())
                    raw = f.read_at(total * size, 8 + int(offset[lo]) * size)
                    if len(raw) != total * size:
                        raise ValueError(f"{held} ends inside a document")
                    ids = memoryview(np.frombuffer(raw, "<u2" if size == 2 else "<u4").astype("<u4")).cast("B")
                    place = 4 * np.r_[0, np.cumsum(n[lo:hi])]
                    crc += [zlib.crc32(ids[p:q]) for p, q in zip(place[:-1].tolist(), place[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(crc, pa.int64())], ["row", "ids_crc32"])
        finally:
            if f is not None:
                f.close()

    return run


def checksums(places: DataFrame, out_dir: str) -> DataFrame:
    """``row, ids_crc32`` of stored documents, read back from ``places(file, offset, n_tokens, ...)``."""
    packed = places.select(F.struct(*places.columns).alias("row"), "file", "offset", "n_tokens")
    dealt = packed.repartition(_partitions(places), F.col("file")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_payload(out_dir), f"row {packed.schema['row'].dataType.simpleString()}, ids_crc32 long")


def indexed_places(stored: DataFrame, index: DataFrame, out_dir: str) -> DataFrame:
    """``doc_id, part, offset, n_tokens, indexed`` of every stored document of :func:`read_directory`.

    The first document of each id has the place that the index gives; an id that the index doesn't have, or has at
    another place than the shard, is an error.  Null ids and repeats of an id aren't in the index: theirs is the shard's.
    """
    at = F.struct("part", "offset", "n_tokens")
    ids = stored.where("doc_id is not null").groupBy("doc_id").agg(F.min(at).alias("at"), F.count("*").alias("copies"))
    ids = materialize(ids, "ids")
    got = lookup(ids, index, out_dir).withColumnRenamed("doc_id", "k")
    right = (F.col("part") == F.col("at.part")) & (F.col("offset") == F.col("at.offset")) & (F.col("n_tokens") == F.col("at.n_tokens"))
    wrong = F.raise_error(F.concat(F.lit("the index has no right place for document "), F.col("doc_id").cast("string")))
    first = ids.join(got, ids.doc_id == got.k, "left").select("doc_id", "part", "offset", F.when(right, F.col("n_tokens")).otherwise(wrong.cast("long")).alias("n_tokens"), F.lit(True).alias("indexed"))
    repeated = ids.where("copies > 1").select(F.col("doc_id").alias("k"), "at")
    again = stored.join(repeated, stored.doc_id == repeated.k).where((F.col("part") != F.col("at.part")) | (F.col("offset") != F.col("at.offset")))
    others = again.select("doc_id", "part", "offset", "n_tokens").unionByName(stored.where("doc_id is null").select("doc_id", "part", "offset", "n_tokens"))
    return first.unionByName(others.withColumn("indexed", F.lit(False)))


def round_trip(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, distinct: bool = False) -> DataFrame:
    """Write, index and read back: ``doc_id, start, n_tokens, ids_crc32, indexed`` per document, all from the files.

    The shards' directories say which documents there are; each key's place comes from the index,
    and the ids from that place (:func:`indexed_places`).
    """
    spark = docs.sparkSession
    out_dir = out_dir or new_dir(spark, "tokens")
    manifest = write_shards(docs, tokenizer_path, out_dir, distinct=distinct)
    index = build_index(manifest, out_dir)
    shards = manifest.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    base = materialize(shards.select("part", "file", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "shards")
    stored = materialize(read_directory(base, out_dir), "directory")
    places = indexed_places(stored, index, out_dir).join(base, "part")
    return checksums(places, out_dir).select(
        "row.doc_id", (F.col("row.base") + F.col("row.offset")).alias("start"), "row.n_tokens", "ids_crc32", "row.indexed"
    )
