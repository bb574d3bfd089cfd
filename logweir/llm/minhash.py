"""Near-duplicate detection: MinHash by one-permutation hashing, star-shaped candidates, exact links.

How a link gets found and confirmed
-----------------------------------
1. One pass over the texts makes each document's set of distinct five-word shingles, its key (a 128-bit
   digest of the set) and ``bands`` band hashes.  The signature comes from ONE hash per shingle: its
   leading bits choose one of ``bands * rows`` bins, the least hash of a bin is its value, and an empty
   bin borrows from the bin that a fixed random sequence of bins meets first (optimal densification),
   so that each borrowed bin draws independently.
2. Equal sets collapse to one representative; copies never meet each other again.
3. A bucket is (band, hash).  Its members are candidates of one member only, the star's centre, so a
   bucket of m members makes m - 1 pairs.  The pairs are confirmed on full sets.
4. A bucket whose members are not all connected by then may hide links between two members that are
   no centre.  Such buckets go through an exact pass.  Overlapping buckets form a group; in a group shingles are ordered by
   rarity, and two sets that are linked share a shingle of their prefixes (a set of n has one of
   n - ceil(0.75 n) + 1).  Members that share none with anyone not connected to them are done; the others, joined by
   shared prefix shingles, are compared in blocks of bounded size: an inverted index per pair of blocks, and only
   confirmed links come out, at most one per member.  So documents that merely share a long passage never meet.
5. Components of the confirmed links, smallest ``doc_id`` first.

With 32 bands of 4 rows a pair of similarity 0.75 shares no bucket with probability
(1 - 0.75^4)^32 = 5e-6.  Sets are compared by 64-bit shingle hashes.

Defined cases: a null or empty text, or one of white space only, has no shingle and is linked with nothing.
Rows with a null ``doc_id`` are returned with a null component and ``kept`` true.  Repeated rows share a
component; ``kept`` is ``doc_id = component_id`` for each of them.  Rows that share a ``doc_id`` but not a
text are compared as different documents, ``mark`` (of id and text) tells them apart.  Very long texts are whole; an empty table gives
an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, _MUL, connected_components, materialize, mix64, shingle_set, tidy

BANDS, ROWS, WORDS = 32, 4, 5
#: A block of the exact pass: this many shingles and members at most (a larger document is a block by itself).
BLOCK_SHINGLES, BLOCK_MEMBERS = 200_000, 1_000
#: A table of units is broadcast up to this many rows of two numbers.
MANY = 1_000_000


class OnePermutation:
    """Densified one-permutation signatures of sorted hash sets; ``bins`` must be a power of two."""

    def __init__(self, bins: int, tries: int = 48) -> None:
        self.bins, self.shift = bins, np.uint64(64 - bins.bit_length() + 1)
        draws = mix64(np.arange(tries * bins, dtype=np.uint64) * _MUL + np.uint64(1))
        self.draws = (draws >> self.shift).astype(np.int64).reshape(tries, bins)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        first = np.empty(len(at), bool)
        first[0] = True
        np.not_equal(at[1:], at[:-1], out=first[1:])
        full = np.zeros(self.bins, bool)
        value = np.zeros(self.bins, np.uint64)
        full[at[first]] = True
        value[at[first]] = hashes[first]
        empty = np.flatnonzero(~full)
        if len(empty):
            met = full[self.draws[:, empty]]
            source = self.draws[met.argmax(0), empty]
            missed = ~met.any(0)
            for attempt in range(1, 1 << 20):  # more draws for the few bins that met no full one
                if not missed.any():
                    break
                more = mix64(empty[missed].astype(np.uint64) * _MUL + np.uint64(attempt << 32))
                source[missed] = (more >> self.shift).astype(np.int64)
                missed = ~full[source]
            value[empty] = value[source]
        return value


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """Rows of signatures -> rows of ``bands`` hashes that differ between bands."""
    parts = signatures.reshape(len(signatures), bands, -1)
    with np.errstate(over="ignore"):
        out = mix64(parts[:, :, 0] + np.arange(1, bands + 1, dtype=np.uint64) * _MUL)
        for i in range(1, parts.shape[2]):
            out = mix64(out * _MUL + parts[:, :, i])
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.view(np.int64)))


def _features(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, oph = WordHashes(), OnePermutation(bands * rows)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                sets = (shingle_set(t.as_py(), hashes, words) for t in part.column(1))
                n, keys, sigs = [], [], []
                for s in sets:
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    if len(s):
                        sigs.append(oph.signature(s))
                found = iter(band_hashes(np.stack(sigs), bands)) if sigs else iter(())
                hashed = pa.array([next(found).view(np.int64) if k else None for k in keys], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), hashed], ["doc_id", "mark", "n", "key", "bands"])

    return run


def _sets(words: int, bitmap: dict[int, bytes]):
    """Sets of the documents whose ``bit`` is in the bitmap (4 KiB chunks of bits, least significant first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            chosen = [i for i, bit in enumerate(b.column(1).to_pylist()) if (c := bitmap.get(bit >> 15)) and c[(bit & 32767) >> 3] >> (bit & 7) & 1]
            for at in range(0, len(chosen), 256):
                sets = [shingle_set(b.column(0)[i].as_py(), hashes, words) for i in chosen[at : at + 256]]
                sets = [s for s in sets if len(s)]
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, _lists(sets)], ["key", "shingles"])

    return run


def _links(share: tuple[int, int]):
    """Confirmed links inside a block or between two blocks, without those between members that are
    connected already."""
    num, den = share

    def run(table: pa.Table) -> pa.Table:
        rid, label, side = (table[c].to_numpy() for c in ("rid", "label", "side"))
        lists = table["shingles"].combine_chunks()
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        m, n = len(rid), np.diff(offsets)
        flat = flat[offsets[0] : offsets[-1]]
        owner = np.repeat(np.arange(m), n)
        order = np.argsort(flat, kind="stable")
        at, first = np.unique(flat[order], return_index=True)
        posting, start = owner[order], np.r_[first, len(flat)]
        place = np.empty(len(flat), np.int64)
        place[order] = np.repeat(np.arange(len(at)), np.diff(start))
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        two, out = len(set(side.tolist())) > 1, []
        bounds = np.r_[0, np.cumsum(n)]
        for x in range(m):
            own = place[bounds[x] : bounds[x + 1]]
            lens = start[own + 1] - start[own]
            own, lens = own[lens > 1], lens[lens > 1]
            if not len(own):
                continue
            index = np.repeat(start[own] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
            common = np.bincount(posting[index], minlength=m)
            hit = den * common >= num * (n[x] + n - common)
            hit[: x + 1] = False
            if two:
                hit &= side != side[x]
            for y in np.flatnonzero(hit):
                p, q = find(int(label[x])), find(int(label[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(rid[x]), int(rid[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def mark_of(docs: DataFrame) -> Column:
    """Digest of a document's id and text."""
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat(id_, F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))


def near_duplicates(docs: DataFrame, share: tuple[int, int] = (75, 100), bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, component, kept`` for every row of ``docs(doc_id, text, ...)``; ``mark`` is :func:`mark_of`,
    ``component`` the component's name, which tells two apart whose smallest ids are the same; null without shingles or id.

    ``share`` = (a, b): a link needs b * intersection >= a * union.
    """
    num, den = share
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark_of(docs).alias("mark"))
    seen = materialize(
        docs.mapInArrow(tidy(_features(bands, rows, words)), "doc_id long, mark string, n long, key binary, bands array<long>"), "minhash"
    )
    compared = seen.where("key is not null and doc_id is not null")
    reps = materialize(
        compared.groupBy("key")
        .agg(F.min("doc_id").alias("doc"), F.first(F.struct("n", "bands")).alias("f"))
        .select(F.monotonically_increasing_id().alias("rid"), "key", "doc", "f.n", "f.bands"),
        "representatives",
    )

    # Buckets of two or more, with the star's centre; the join can split a hot bucket, the count combines early.
    # Sizes go along, so that pairs that can't be similar never get their sets.
    member = reps.select("rid", "n", F.explode("bands").alias("bucket"))
    bucket = member.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rid", "n")).alias("first")).where("size > 1")
    shared = materialize(member.join(bucket, "bucket").select("bucket", "rid", "n", F.col("first.rid").alias("center"), F.col("first.n").alias("center_n")), "buckets")
    near = F.least("n", "center_n") * den >= F.greatest("n", "center_n") * num
    star = shared.where(F.col("rid") != F.col("center")).where(near).select("center", "rid").distinct()

    # Sets of the documents in those buckets; a bitmap of bounded size keeps other texts out of the shuffle.
    need = reps.join(shared.select("rid").distinct(), "rid", "left_semi").select("rid", "key", "doc")
    count = need.count()
    bits = 1 << min(27, max(16, (16 * count).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    chunks = (
        need.select(bit("doc").alias("bit"))
        .groupBy(F.shiftright("bit", 15).alias("chunk"))
        .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bytes"))
    )
    bitmap = {r.chunk: bytes(r.bytes) for r in chunks.collect()}  # 2^27 bits = 16 MiB at most
    found = docs.where("doc_id is not null").select("text", bit("doc_id").alias("bit")).mapInArrow(tidy(_sets(words, bitmap)), "key binary, shingles array<long>")
    sets = materialize(found.dropDuplicates(["key"]).join(need.select("rid", "key"), "key").select("rid", "shingles"), "sets")

    common = F.size(F.array_intersect("s", "shingles"))
    first = materialize(
        star.join(sets.select(F.col("rid").alias("center"), F.col("shingles").alias("s")), "center")
        .join(sets, "rid")
        .where(common * den >= (F.size("s") + F.size("shingles") - common) * num)
        .select(F.col("center").alias("a"), F.col("rid").alias("b")),
        "links",
    )

    links = first.unionByName(_rest(shared, reps, sets, first, share))
    parts = connected_components(links)
    names = (
        parts.join(reps.select(F.col("rid").alias("id"), "key", "doc"), "id")
        .select("key", "component_id", "doc")
    )
    least = names.groupBy("component_id").agg(F.min("doc").alias("least"), F.min("key").alias("name"))
    known = names.join(least, "component_id").select("key", F.col("least").alias("linked"), "name")
    alone = compared.groupBy("key").agg(F.min("doc_id").alias("doc"))
    of = alone.join(known, "key", "left").select("key", F.coalesce("linked", "doc").alias("least"), F.coalesce("name", "key").alias("name"))
    out = seen.select("doc_id", "mark", "n", "key").join(of, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select(
        "doc_id",
        "mark",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.hex("name")).alias("component"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _rest(shared: DataFrame, reps: DataFrame, sets: DataFrame, first: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links that no star has: pairs of members that are not centres, in buckets that the star's links
    leave in two parts or more.
    """
    num, den = share
    parts = connected_components(first)
    labelled = shared.join(parts.withColumnRenamed("id", "rid"), "rid", "left").select(
        "bucket", "rid", "center", F.coalesce("component_id", "rid").alias("label")
    )
    split = (
        labelled.groupBy("bucket")
        .agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("m > 2 and lo <> hi")
        .select("bucket")
    )
    active = materialize(labelled.join(split, "bucket"), "active")
    groups = connected_components(active.where("rid <> center").select("center", "rid"), "center", "rid")
    rows = groups.select(F.col("id").alias("rid"), F.col("component_id").alias("grp")).join(active.select("rid", "label").distinct(), "rid")
    # Prefixes: a set's rarest shingles within its group.
    each = materialize(rows.join(sets, "rid").select("grp", "rid", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "members")
    common = each.groupBy("grp", "s").agg(F.count("*").alias("k")).where("k > 1")
    kept = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    place = F.row_number().over(Window.partitionBy("grp", "rid").orderBy("k", "s"))  # a document's own shingles
    ranked = each.join(common, ["grp", "s"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("place", place)
    prefix = materialize(ranked.where((F.col("place") <= kept) & (F.col("k") > 1)).select("grp", "rid", "label", "s"), "prefixes")
    posting = prefix.groupBy("grp", "s").agg(F.min("rid").alias("center"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    met = prefix.join(posting.select("grp", "s", "center"), ["grp", "s"]).where("rid <> center").select("center", "rid").distinct()
    units = connected_components(met, "center", "rid").select(F.col("id").alias("rid"), F.col("component_id").alias("unit"))
    todo = materialize(units.join(rows.select("rid", "label"), "rid").join(reps.select("rid", "n"), "rid"), "units")
    sizes = todo.groupBy("unit").agg(
        F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_SHINGLES), F.count("*") / F.lit(BLOCK_MEMBERS))).cast("int").alias("blocks")
    )
    # The units of one block need no join; those of more are few.
    large = F.broadcast(sizes.where("blocks > 1")) if sizes.where("blocks > 1").count() <= MANY else sizes.where("blocks > 1")
    placed = todo.join(large, "unit", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "rid", "label"
    )
    return dealt.join(sets, "rid").groupBy("unit", "i", "j").applyInArrow(_links(share), "a long, b long")
