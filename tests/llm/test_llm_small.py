"""Edge cases of the operators: nulls, empty and repeated rows, ties, empty tables, clashing columns, brute force."""

import gzip
import hashlib
import os
import platform
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweir.llm import common, decontaminate, licenses, minhash, mixing, pii, quality, tokens, toxicity, urlfilter, warc
from logweir.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, start=0, source="s"):
    return spark.createDataFrame([(start + i, t, "en", source, None) for i, t in enumerate(texts)], DOCS)


# --------------------------------------------------------------------------- components
def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.id: r.component_id for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --------------------------------------------------------------------------- near duplicates
def brute_components(rows, share=(75, 100)):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "w%d" % rng.randrange(400)
    base = [word() for _ in range(120)]
    texts = ["", None, " \n", "One two", "one TWO", "one two three four five", "a b c d e f"]
    for _ in range(60):  # a family around one text: some are linked to it, some only to each other
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    shared = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(50)] + shared) for _ in range(30)] + [" ".join(base)] * 3
    df = docs(spark, *texts).withColumn("n_shingles", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y z"), (2, "q"), (2, "r")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 2, True), (2, 2, True)], key=str)
    assert minhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_signatures_estimate_similarity():
    oph, rng = minhash.OnePermutation(128), np.random.default_rng(0)
    for n in (3, 40, 2000):
        hits = []
        for _ in range(60):
            x = rng.integers(0, 1 << 64, n * 2, dtype=np.uint64)
            a, b = np.sort(x[: n + n // 2]), np.sort(x[n // 2 :])
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            hits.append((oph.signature(a) == oph.signature(b)).mean() - inter / union)
        assert abs(np.mean(hits)) < 0.06


# --------------------------------------------------------------------------- url filter
def test_url_rules(spark):
    urls = [
        ("HTTP://WWW.Example.COM/en/75?x", "allow", "example.com/en/7"), ("http://a.com/en/", "block", "com/en/"), ("http://a.com/en", "allow", None), ("http://notcom/en/", "allow", None),
        ("http://x.net/de/8", "allow", "net/de/"), ("http://example.net/de/88", "block", "example.net/de/8"), ("http://org/es/#f", "block", "org/es/"), ("http://casino.test", "block", None),
        ("casino.test/en/", "allow", None), (None, "allow", None), ("x://", "allow", None), ("a://b://c/d", "allow", None),
    ]
    df = spark.createDataFrame([(i, u[0], "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, html string")
    got = {r.row.page_id: r for r in urlfilter.judge(df).collect()}
    assert [(got[i].verdict, got[i].rule) for i in range(len(urls))] == [(u[1], u[2]) for u in urls]
    assert (got[0].host, got[0].path) == ("www.example.com", "/en/75") and (got[8].host, got[8].path) == ("", "") and (got[11].host, got[11].path) == ("b:", "//c/d")


def test_url_rules_from_a_file(spark, tmp_path):
    """Sites in any case, hosts alone, globs and words; the table of rules means what the rules mean, broadcast or not."""
    (tmp_path / "rules.txt").write_text("# comment\nblock Example.com/en/\nallow example.com/en/ok\nblock com\nBLOCK */Ads/*.gif\nblock =casino # a word\nallow\tcom.test/x\n\nblock *track*# all of them\nblock =Pay-Day\nblock odd.org/a\\Eb\nallow odd.org/a\\Eb/c\n")
    urls = [
        ("http://EXAMPLE.com/en/1", "block", "Example.com/en/"), ("http://a.example.com/en/ok", "allow", "example.com/en/ok"), ("http://x.com/", "block", "com"), ("http://computer.org/", "allow", None), ("http://com", "block", "com"),
        ("http://a.org/ADS/1/b.gif", "block", None), ("http://a.org/ads/b.gifx", "allow", None), ("http://my-casino.org", "block", None), ("http://com.test/xy", "allow", "com.test/x"), ("http://a.org/betracked", "block", None),
        ("http://my.pay-day.net/", "block", None), ("http://pay-days.net/", "allow", None), ("http://payday.net/", "allow", None), ("http://odd.org/a\\Eb", "block", "odd.org/a\\Eb"), ("http://odd.org/a\\Eb/c", "allow", "odd.org/a\\Eb/c"), ("http://odd.org/ab", "allow", None),
        ("http://a.org/" + "y" * 100_000 + "/ads/" + "z" * 100_000 + ".gif", "block", None),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)] * 2 + [(99, None)], "page_id long, url string").withColumns({"rule": F.lit("clash"), "verdict": F.lit(0)})
    own = tuple(urlfilter.site_rule(n, v) for n, v in (("Example.com/en/", "block"), ("example.com/en/ok", "allow"), ("com", "block"), ("com.test/x", "allow"), ("odd.org/a\\Eb", "block"), ("odd.org/a\\Eb/c", "allow")))
    own += (urlfilter.glob_rule("*/Ads/*.gif"), urlfilter.word_rule("casino"), urlfilter.glob_rule("*track*"), urlfilter.word_rule("Pay-Day"))
    for rules in (urlfilter.read_rules(spark, str(tmp_path / "rules.txt")), own):
        for most in (50_000, 0):
            urlfilter.BROADCAST_RULES, kept = most, urlfilter.BROADCAST_RULES
            try:
                got = {(r.row.page_id, r.verdict, r.rule) for r in urlfilter.judge(df, rules).collect()}
            finally:
                urlfilter.BROADCAST_RULES = kept
            assert got == {(i, u[1], u[2]) for i, u in enumerate(urls)} | {(99, "allow", None)}
    assert urlfilter.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["bad line here", "block", "block a.com b.com", "block =", "deny a.com"])
def test_url_rules_that_are_none(spark, tmp_path, line):
    (tmp_path / "rules.txt").write_text(f"block a.com\n{line}\n")
    with pytest.raises(Exception, match=f"no rule: {line}"):
        urlfilter.judge(spark.createDataFrame([(1, "http://a.com")], "page_id long, url string"), urlfilter.read_rules(spark, str(tmp_path / "rules.txt"))).collect()


def test_url_rules_of_equal_length(spark):
    """Of rules that fit equally long, one that blocks decides, and a repeated one is one."""
    rules = tuple(urlfilter.site_rule(n, v) for n, v in (("a.com/x", "allow"), ("a.com/x", "block"), ("a.com/x", "allow")))
    df = spark.createDataFrame([(1, "http://a.com/x1"), (1, "http://a.com/x1")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()] == [("a.com/x", "block")] * 2


# --------------------------------------------------------------------------- warc
def test_warc_round_trip(spark):
    df = spark.createDataFrame([(1, "http://a", "x"), (2, None, "x"), (3, "u\r\nX: y", ""), (4, "u", None), (None, "u", "é" * 70_000), (5, "u", "z")], "page_id long, url string, html string").repartition(3)
    out = common.new_dir(spark, "t")
    rows = {r.page_id: r for r in warc.read_warc(warc.write_warc(df, out), out).collect()}
    assert rows[1].record_type == "revisit" and rows[1].refers_to == 2 and rows[2].record_type == "response" and rows[3].refers_to == 4
    assert rows[None].payload.decode() == "é" * 70_000 and rows[3].payload_bytes == 0 and rows[1].payload_digest == rows[2].payload_digest == warc.digest_of(b"x")
    assert rows[3].url == "u%0D%0AX: y" and rows[2].url is None and all(r.verified for r in rows.values())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_ties_repeats_and_clashes(spark):
    """Pages that share the largest id of a payload are all responses; repeated rows are records of their own; other columns don't matter."""
    rows = [(7, "u", "same"), (7, "v", "same"), (3, "u", "same"), (3, "u", "same"), (None, "u", "only null"), (9, "long", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit("clash"), "kind": F.lit(1), "mark": F.lit(2), "refers": F.lit(3)})
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted([(7, "response", None, 4)] * 2 + [(3, "revisit", 7, 4)] * 2 + [(None, "response", None, 9), (9, "response", None, 3_000_000)], key=str)


def test_warc_archives_are_read_in_as_many_tasks(spark):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(40)], "page_id long, url string, html string")
    out = common.new_dir(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archives = warc.write_warc(df, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = warc.read_warc(archives, out)
    assert archives.count() == 4 and read.select(F.spark_partition_id()).distinct().count() == 4 and read.count() == 40


def test_warc_of_other_writers(spark, tmp_path):
    """Records without digests, with other ids, types and heads, as other tools write them."""
    http = "HTTP/1.1 200 OK\r\nServer:x\r\nX-Long: a\r\n b\r\n\r\n"
    plain = [
        ("warcinfo", {"WARC-Record-ID": "<urn:uuid:a>", "Content-Type": "application/warc-fields"}, "software: x\r\n"),
        ("request", {"WARC-Record-ID": "<urn:uuid:b>", "Content-Type": "application/http;msgtype=request", "WARC-Target-URI": "http://a/"}, "GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        ("response", {"WARC-Record-ID": "<urn:uuid:c>", "Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "http://a/"}, http + "body\r\n\r\nmore"),
        ("response", {"WARC-Record-ID": "<urn:uuid:d>", "Content-Type": "application/http", "WARC-Payload-Digest": "sha1:" + hashlib.sha1(b"x").hexdigest()}, http + "x"),
        ("resource", {"WARC-Record-ID": "<urn:uuid:e>", "WARC-Block-Digest": "md5:" + hashlib.md5(b"y").hexdigest()}, "y"),
        ("revisit", {"WARC-Record-ID": "<urn:uuid:f>", "WARC-Refers-To": "<urn:uuid:c>", "Content-Type": "application/http"}, http),
    ]
    raw = b"".join(gzip.compress(("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **head, "Content-Length": len(body)}.items()) + "\r\n" + body + "\r\n\r\n").encode()) for kind, head, body in plain)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    archives = spark.createDataFrame([("a.warc.gz",)], "file string")
    rows = warc.read_warc(archives, f"file://{tmp_path}", types=None).collect()
    assert [(r.record_type, r.record_id, r.verified) for r in rows] == [(k, h["WARC-Record-ID"], {"<urn:uuid:d>": True, "<urn:uuid:e>": True}.get(h["WARC-Record-ID"])) for k, h, _ in plain]
    assert bytes(rows[2].payload) == b"body\r\n\r\nmore" and rows[2].payload_digest == warc.digest_of(bytes(rows[2].payload)) and rows[5].payload is None and rows[5].payload_bytes is None
    assert [r.record_id for r in warc.read_warc(archives, f"file://{tmp_path}").collect()] == ["<urn:uuid:c>", "<urn:uuid:d>", "<urn:uuid:f>"]
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n")


@pytest.mark.parametrize("digest_sent", [False, True])
def test_warc_of_chunked_bodies(digest_sent):
    body = b"5\r\nhello\r\n8;name=x\r\n, world\n\r\n0\r\nTrailer: x\r\n\r\n"
    assert warc.dechunked(body) == b"hello, world\n" and warc.dechunked(b"0\r\n\r\n") == b""
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    said = warc.digest_of(body if digest_sent else b"hello, world\n")
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (said.encode(), len(block))
    got = warc.parse(raw + block + b"\r\n\r\n")
    assert got["verified"] and got["payload"] == b"hello, world\n" and got["payload_bytes"] == 13
    assert warc.parse(raw + block.replace(b"hello", b"hallo") + b"\r\n\r\n")["verified"] is False


@pytest.mark.parametrize("body", [b"", b"plain", b"5\r\nhel", b"5\r\nhello\r\n", b"3\r\nhello\r\n0\r\n\r\n"])
def test_warc_bodies_that_only_claim_chunks(body):
    assert warc.dechunked(body) is None
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (warc.digest_of(body).encode(), len(block))
    got = warc.parse(raw + block + b"\r\n\r\n")
    assert got["verified"] and got["payload"] == body


def test_warc_damage():
    good = warc.record("response", 1, "u", b"hello", None)
    raw = next(warc.members(__import__("io").BytesIO(good)))
    assert warc.parse(raw)["verified"] and not warc.parse(raw.replace(b"hello", b"hallo"))["verified"]
    with pytest.raises(ValueError):
        list(warc.members(__import__("io").BytesIO(good[:-9])))
    with pytest.raises(ValueError):
        warc.parse(raw[:-6])


# --------------------------------------------------------------------------- toxicity
def test_segments_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(0, 12)).astype(float)
        got = toxicity.segments(s)

        def best(lo, hi):  # the recursive definition: a maximal segment, then both sides
            cand = [(s[i:j].sum(), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
            cand = [c for c in cand if c[0] > 0]
            if not cand:
                return []
            _, _, _, i, j = max(cand)
            return best(lo, i) + [(i, j)] + best(j, hi)

        want = best(0, len(s))
        assert sum(e[2] for e in got) == pytest.approx(sum(s[i:j].sum() for i, j in want))
        assert not got or max(e[2] for e in got) == pytest.approx(max(s[i:j].sum() for i, j in want))
        # Without ties the segments are the same ones.
        s = rng.normal(-0.3, 1, len(s))
        assert [(i, j) for i, j, _ in toxicity.segments(s)] == best(0, len(s))


def test_toxic_words_of_any_length_and_script():
    assert toxicity.words_of("A\u00a0b,c_d\u3000Été 12") == [b"a", b"b", b"c", b"d", "été".encode(), b"12"] and toxicity.words_of(None) == toxicity.words_of("--") == []
    assert toxicity.words_of("x" * 32) == [b"x" * 32] and toxicity.words_of("ok " + "y" * 40) == [b"ok"] + [b"yyyy"] * 37
    assert toxicity.words_of("語" * 33) == [("語" * 4).encode()] * 30 and len(toxicity.words_of("ab" * 100_000)) == 199_997


def test_toxicity_matches_brute_force(spark):
    """Log-odds, back-off, extreme values, evidence and score by their definitions, with more than 64 passages and long words in the texts."""
    rng = random.Random(21)
    rows, labels, calm = [], {}, ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    for i in range(400):
        y = i % 3 == 0 or i % 50 == 0
        words = [rng.choice(calm) if rng.random() > (0.3 if y else 0.02) else rng.choice(["vile", "nasty"] + ["q" * 70] * y) for _ in range(rng.randrange(5, 60))]
        if i % 50 == 0:
            words = (["vile", "nasty", "vile"] + [rng.choice(calm) for _ in range(80)]) * 70
        rows.append((i, " ".join(words)))
        labels[i] = int(y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    held = {r.doc_id for r in df.where(F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).collect()}

    def words(t):
        out = []
        for w in re.findall("[a-z0-9]+", t.lower()):
            out += [w] if len(w) <= 32 else [w[i : i + 4] for i in range(len(w) - 3)]
        return out

    keys = lambda w: ["w" + w, "5" + w[:5], "4" + w[:4]]
    count = {}
    for i, t in rows:
        if i not in held:
            for w in set(words(t)):
                for k in keys(w):
                    count.setdefault(k, [0, 0])[labels[i]] += 1
    total = [sum(v[y] for k, v in count.items() if k[0] == "w") for y in (0, 1)]
    odds, known = {}, {}
    for k, (c, t) in count.items():
        a = toxicity.PRIOR * (c + t)
        o = np.log((t + a) / (total[1] + toxicity.PRIOR * sum(total))) - np.log((c + a) / (total[0] + toxicity.PRIOR * sum(total)))
        odds[k] = (o, o / np.sqrt(1 / (t + a) + 1 / (c + a)))
        if abs(odds[k][1]) >= toxicity.Z and c + t >= toxicity.SEEN:
            known[k] = o if o > 0 else max(o, -1.0)
    for k, (c, t) in count.items():
        if k[0] == "w" and abs(odds[k][1]) < toxicity.Z and c + t >= toxicity.SEEN and {x for x in keys(k[1:])[1:]} & known.keys():
            known.setdefault(k, toxicity.IDLE)
    assert {k.decode(): pytest.approx(v) for k, v in model.known.items()} == known
    score = lambda t: np.array([next((known[k] for k in keys(w) if k in known), toxicity.IDLE) for w in words(t)])

    def passages(s):  # the recursive definition, by running totals
        found, todo = [], [(0, len(s))]
        while todo:
            lo, hi = todo.pop()
            total, low, at, best = 0.0, 0.0, lo, (0.0, 0, 0)
            for j in range(lo, hi):
                total += s[j]
                if total - low > best[0] + 1e-12:
                    best = (total - low, at, j + 1)
                if total < low:
                    low, at = total, j + 1
            if best[0] > 0:
                found.append(best[0])
                todo += [(lo, best[1]), (best[2], hi)]
        return found

    clean = np.concatenate([np.round(score(t), 1) for i, t in rows if i in held and not labels[i]])
    assert np.mean(np.exp(model.rate * clean)) == pytest.approx(1, abs=1e-6) and model.rate > 0
    quiet = [(len(words(t)), max(passages(score(t)), default=0.0)) for i, t in rows if i in held and not labels[i]]
    assert model.k == pytest.approx(len(quiet) / sum(n * np.exp(-model.rate * x) for n, x in quiet))

    def evidence(t):
        level = np.log(max(model.k * len(words(t)), 1))
        x = np.array(passages(score(t)))
        return max([-level, *(model.rate * x - level)]), np.log1p(np.maximum(model.rate * x - level, 0).sum() if len(x) else 0)

    x = np.array([(1, *evidence(t)) for i, t in rows if i in held])
    y, w = np.array([labels[i] for i, _ in rows if i in held]), np.array(model.curve)
    assert abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 1e-2 * w).max() < 1e-4  # the curve's likelihood is at its top
    got = {r.row.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert got == {i: pytest.approx(1 / (1 + np.exp(-(w @ (1, *evidence(t))))), abs=1e-6) for i, t in rows}
    assert max(len(passages(score(t))) for _, t in rows) > 64
    with pytest.raises(ValueError, match="telling"):
        toxicity.fit(df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), max_tokens=1)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = ["w%d" % rng.randrange(50) for _ in range(40)]
        if i % 6 == 0:
            words[rng.randrange(40)] = words[rng.randrange(40)] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    df = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "nasty vile")], "doc_id long, text string").withColumn("score", F.lit(0))
    known = spark.createDataFrame(labels[:500] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    got = {r.row.doc_id: r for r in toxicity.score(df, model).collect()}
    wrong = sum((got[i].score >= 0.5) != bool(y) for i, y in labels[500:])
    assert wrong <= 2 and 0 <= got[9000].score == got[9001].score < 0.5 and len(got[0].starts) >= 1
    assert toxicity.score(df, toxicity.fit(df, known.limit(0))).where("score = 0").count() == df.count()


# --------------------------------------------------------------------------- licenses
def test_licenses(spark):
    long = licenses.TEMPLATES["MIT-text"]
    df = docs(spark, f"intro words here. {long.upper()}! more", "Released under the MIT license", None, "", "under the", long[: len(long) // 3]).withColumn("license", F.lit("x"))
    got = [[m.license for m in r.matches] for r in licenses.scan(df).orderBy("row.doc_id").collect()]
    assert got == [["MIT-text"], ["MIT"], [], [], [], []]
    none = spark.createDataFrame([], "license string, text string")
    assert licenses.scan(df, none).where(F.size("matches") > 0).count() == 0


# --------------------------------------------------------------------------- personal data
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [
        "a@b.c_d@e.f", "x@y", "@a.b", "é a.b@c.d😀 1.2.3.4.5.6.7.8", "1.2.3.999 001.2.3.4", "4111 1111 1111 1111", "4111-1111 1111-1112", "+1 (555) 123-4567+44 20 7946 0958", "+12", "", "9" * 30_000, "a" * 30_000, "a.b@" + "c." * 20_000 + "d",
    ] + ["".join(rng.choice("ab1.9@-+ (5)é\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = docs(spark, *texts, None).withColumn("base", F.lit(1))
    got = {r["doc_id"]: r["b"] for r in pii.entities(df).select("row.doc_id", pii.listed("base").alias("b")).collect()}
    assert got == {i: brute_pii(t) for i, t in enumerate(texts)} | {len(texts): ""}


def test_pii_bootstrap(spark):
    seeds = [f"please write to contact address user{i}@mail{i}.example.com today" for i in range(12)]
    df = docs(spark, *seeds, "please write to contact address QX-7719-204 now", "in the year 12345678 nothing")
    spans = [r["s"] for r in pii.entities(df).orderBy("row.doc_id").select(pii.listed("spans").alias("s")).collect()]
    assert spans[12] == "id:32:43" and spans[13] == ""


def test_pii_candidates_are_whole_runs(spark):
    """Short runs whose digits stand at the end are candidates, and many values not seen before don't make a context weak."""
    runs = ["EMP-2041", "ABCD1234", "ID-12345", "CUST-00123", "x12345"]
    seeds = [f"please write to contact address user{i}@mail{i}.example.com today" for i in range(12)]
    df = docs(spark, *seeds, *[f"please write to contact address {r} now" for r in runs], *[f"please write to contact address {r} now" for r in ("A12", "A1234", "abcdef")])
    spans = [r["s"] for r in pii.entities(df).orderBy("row.doc_id").select(pii.listed("spans").alias("s")).collect()]
    assert spans[12:] == [f"id:32:{32 + len(r)}" for r in runs] + ["", "id:32:37", ""]


def brute_spans(texts):
    """All spans by the definitions, with dictionaries."""
    base = [[(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_pii(t).split(",") if x)] for t in texts]
    kinds = {k: i for i, k in enumerate(pii.KINDS)}

    def shape(v):
        if re.fullmatch("[0-9]+", v):
            return f"digits {len(v)}"
        return len(v) >= 16 and f"{'hex' if re.fullmatch('[0-9a-f]+|[0-9A-F]+', v) else 'mixed'} {len(v)}"

    def patterns(t, a, b, value):
        before, after = t[:a].lower(), t[b:].lower()
        stuck = re.search(r"[^\s\w]*\Z", before)[0]
        words = before[: len(before) - len(stuck)].split()
        stuck_after = re.match(r"[^\s\w]*", after)[0]
        behind = after[len(stuck_after) :].split()
        out = set()
        if len(words) > 1:
            out.add(("L", words[-2], words[-1], stuck))
        if words and behind:
            out.add(("B", words[-1], stuck, stuck_after, behind[0]))
        return out | ({("S", shape(value))} if value and shape(value) else set())

    cue = re.compile(r"(?:^|[^a-z])(?:" + "|".join(pii.CUES) + r")s?[\"']?\s*[:=]\s*[\"']?\Z", re.I)
    edges, found = {}, []
    for d, t in enumerate(texts):
        each = [(a, b, True, None) for _, a, b in base[d]]
        for m in re.finditer(r"(?<![0-9A-Za-z_-])[A-Za-z_-]*[0-9][0-9A-Za-z_-]*", t):
            if len(m[0]) >= pii.LENGTH and not any(a < m.end() and m.start() < b for _, a, b in base[d]):
                each.append((m.start(), m.end(), bool(cue.search(t[: m.start()])), m[0]))
        for a, b, seed, value in each:
            own = patterns(t, a, b, value)
            if value:
                found.append((d, a, b, own))
            for p in own:
                edges[p, t[a:b]] = edges.get((p, t[a:b]), False) or seed
    seed = {}
    for (_, v), s in edges.items():
        seed[v] = max(seed.get(v, 0.0), float(s))
    score, strong = dict(seed), {}
    for _ in range(pii.ROUNDS):
        of = {}
        for p, v in edges:
            of.setdefault(p, []).append(score[v])
        rate = {p: sum(x) / (sum(y > 0 or p[0] == "S" and p[1].startswith("digits") for y in x) + 1) for p, x in of.items()}
        strong = {p: c for p, c in rate.items() if c >= pii.STRONG and sum(y >= pii.STRONG for y in of[p]) >= pii.SUPPORT}
        miss = {}
        for p, v in edges:
            miss[v] = miss.get(v, 1.0) * (1 - strong.get(p, 0.0))
        score = {v: max(seed[v], 1 - miss[v]) for v in seed}
    out = [sorted((kinds[k], k, a, b) for k, a, b in own) for own in base]
    for d, a, b, own in found:
        if own & strong.keys():
            out[d].append((4, "id", a, b))
    return [",".join(f"{k}:{a}:{b}" for _, k, a, b in sorted(x)) for x in out]


def test_pii_spans_match_brute_force(spark):
    rng = random.Random(15)
    word = lambda: rng.choice("the of on with to call please write number order is at".split())
    number = lambda n, letters="0123456789": "".join(rng.choice(letters) for _ in range(n))
    some = [
        lambda: f"u{rng.randrange(40)}@m{rng.randrange(9)}.org", lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f'token = "{number(40, "0123456789abcdef")}"', lambda: number(rng.choice([4, 8, 16])),
        lambda: f"order ({number(6)})", lambda: "AB-" + number(4), lambda: f"password: {number(9, 'abc123')}1,", lambda: "w" * 300 + " x1234",
    ]
    texts = [" ".join(rng.choice(some)() if rng.random() < 0.25 else word() for _ in range(rng.randrange(30))) for _ in range(150)] + ["", "  ", "x" * 5000 + " " + "y" * 200 + " a1234 " + "z" * 400]
    got = {r["doc_id"]: r["s"] for r in pii.entities(docs(spark, *texts)).select("row.doc_id", pii.listed("spans").alias("s")).collect()}
    want = brute_spans(texts)
    assert [got[i] for i in range(len(texts))] == want and sum("id:" in x for x in want) > 10


def test_pii_finds_planted_identifiers(spark):
    """Identifiers that no base pattern has: after the words that lead to known ones, in assignments, and by a shape seen there."""
    rng = random.Random(16)
    number = lambda n, letters="0123456789": "".join(rng.choice(letters) for _ in range(n))
    filler = lambda: " ".join(rng.choice("la mer est un jour de vent sur terre".split()) for _ in range(12))
    secret = lambda: number(39, "0123456789abcdef") + "f"
    rows, planted = [], {}
    for i in range(600):
        before, value = filler(), ""
        if i % 6 == 0:
            before, value = before + " reach me at", f"user{i}@mail.example.com" if i % 12 else f"EMP-{number(5)}"
        elif i % 6 == 1:
            before, value = before + ' token = "', secret()
        elif i % 6 == 2:
            value = secret()
        elif i % 6 == 3:
            value = number(rng.choice([4, 6, 12]))
        text = before + (" " if value and before[-1] != '"' else "") + value + (" " if before[-1] != '"' else '" ') + filler()
        rows.append((i, text))
        if i % 12 == 0 or i % 6 in (1, 2):
            planted[i] = f"id:{text.index(value)}:{text.index(value) + len(value)}"
    got = {r["doc_id"]: [x for x in r["s"].split(",") if x.startswith("id")] for r in pii.entities(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", pii.listed("spans").alias("s")).collect()}
    hits = sum(planted[i] in got[i] for i in planted)
    assert hits >= 0.9 * len(planted) and hits >= 0.9 * sum(map(len, got.values()))
    none = pii.entities(docs(spark).limit(0))
    assert none.count() == 0 and pii.entities(docs(spark, *["a@b.c 12345"] * 5)).select("spans").distinct().count() == 1


# --------------------------------------------------------------------------- toxicity, repeated keys
def test_toxicity_calibration_with_one_key_in_most_rows(spark):
    """Copies of a labelled row, and many texts of one id, don't exceed the bound of the calibration."""
    rng = random.Random(12)
    text = lambda bad: " ".join(rng.choice(["vile", "nasty"] if bad and rng.random() < 0.5 else ["sun", "tree", "road", "cat"]) for _ in range(30))
    rows = [(i, text(i % 2)) for i in range(40)]
    rows += [rows[k] for k in range(8) for _ in range(60)] + [(k, text(k % 2) + f" n{j}") for k in range(8, 16) for j in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, labels, max_rows=50)
    got = {(r.row.doc_id, r.score >= 0.5) for r in toxicity.score(df, model).collect()}
    assert model.curve is not None and sum(toxic == bool(i % 2) for i, toxic in got) >= 0.9 * len(got)


# --------------------------------------------------------------------------- tokens
def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "x|! y|!", "a <|endoftext|>. b", "é\x85 \u200bz, ", "hello world", " lead  double\ttab\n\nx ", "it's don't, a.b (c)! \u00a0x", "日本 語", "<|endoftext|> end", "word," * 50, "  ", "a\u2003 b", "x 'll y"]
    rows = [(i * 7 % 17, x) for i, x in enumerate(texts)] + [(None, "last one"), (3, "again"), (3, "again"), (3, "again, longer" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = sorted(tokens.round_trip(df, tokenizer_path()).collect(), key=lambda r: r.start)
    ids = {}
    for k, x in rows:
        ids.setdefault(k, []).append(t.encode(x or "", add_special_tokens=False).ids + [2])
    start = 0
    assert [r.indexed for r in got] == [r.doc_id is not None and (i == 0 or got[i - 1].doc_id != r.doc_id) for i, r in enumerate(got)]
    assert [r.doc_id for r in got] == sorted([k for k, _ in rows if k is not None]) + [None]
    for r in got:
        want = next(x for x in ids[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        ids[r.doc_id].remove(want)
        assert (r.start, r.n_tokens) == (start, len(want))
        start += len(want)
    assert tokens.round_trip(df.limit(0), tokenizer_path()).count() == 0


def test_one_row_in_half_of_the_table(spark, tmp_path):
    """No shard has more than twice the median; the keys, repeats and long texts come back whole."""
    spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "again and again").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text")).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    shards = tokens.write_shards(df, tokenizer_path(), common.new_dir(spark, "hot"), shards=8)
    sizes = sorted(r["count"] for r in shards.groupBy("part").count().collect())
    assert sum(sizes) == 20_000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    long = docs(spark, "word " * 300_000, "x", "x", None)
    for table, n in ((df, 20_000), (long, 4), (long.union(long), 8)):
        rows = sorted(tokens.round_trip(table.select("doc_id", "text"), tokenizer_path()).collect(), key=lambda r: r.start)
        assert len(rows) == n and [r.start for r in rows] == [sum(q.n_tokens for q in rows[:i]) for i in range(n)] if n < 100 else len(rows) == n
        assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_encoder_matches_the_tokenizer():
    """Texts of any characters, cut into slices, in a cold and a warm cache."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokenizer_path()), random.Random(14)
    letters = " \n\t  \u00a0\u3000ab cdé日本.,!?'1²_<|endoftext|>\x1c\x85\u200b😀\u0301-\r"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None, "", " a", "a ", " <|endoftext|>", "<|endoftext|>. x<|endoftext|>y"]
    own, array = tokens.Encoder(tokenizer_path()), pa.array(texts)
    want = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    for most in (100, 1 << 20):
        got, places = [], list(tokens.slices(array, most))
        assert places[0][0] == 0 and places[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(places, places[1:]))
        for lo, hi in places:
            ids, n = own.encode(array.slice(lo, hi - lo), 2)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want


def test_a_wrong_index_is_an_error(spark):
    df = docs(spark, *["some words"] * 20)
    out, other = common.new_dir(spark, "t"), common.new_dir(spark, "t")
    shards = tokens.write_shards(df, tokenizer_path(), out)
    stored = tokens.read_directory(shards.select("part", "file").distinct(), out)
    index = tokens.build_index(tokens.write_shards(df.where("doc_id < 19"), tokenizer_path(), other), out)
    with pytest.raises(Exception, match="no right place"):
        tokens.indexed_places(stored, index, out).collect()


def test_folders_of_object_stores():
    assert [common.arrow_uri(u) for u in ("s3a://b/a", "dbfs:/a/b", "/a/b", "file:/a", "hdfs://h/a")] == ["s3://b/a", "file:///dbfs/a/b", "file:///a/b", "file:/a", "hdfs://h/a"]
    assert common.open_folder("/a/b")[1] == common.open_folder("file:///a/b")[1] == "/a/b"


def test_perfect_hash():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    p = tokens.PerfectHash.build(keys)
    assert sorted(p.slots(keys).tolist()) == list(range(len(keys)))
    other = np.arange(1000, dtype=np.uint64)
    slots, marks = p.slots(other), np.zeros(len(keys), np.uint32)
    marks[p.slots(keys)] = tokens.fingerprint(keys)
    assert not (marks[slots[slots >= 0]] == tokens.fingerprint(other)[slots >= 0]).any()


# --------------------------------------------------------------------------- decontamination
def test_contamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "c", "dé"])
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 4, 10, 13])))) for i in range(12)] + [(50, ""), (51, None), (None, "a b"), (3, "b b")]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "--", "A,b", "x a B! c"]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    want = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for i, x in items:
            iw = words(x)
            n = min(10, len(iw))
            for p in range(len(iw) - n + 1 if n and i is not None else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == iw[p : p + n]:
                        hit |= set(range(q, q + n))
                        found.add(str(i))
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    df, bench = docs(spark, *texts).withColumn("n_words", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    for size in (1_000_000, 20):  # sent to the tasks, kept as tables
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(decontaminate.contamination(df, bench)).collect()}
        assert got == want


@pytest.mark.parametrize("size", [1_000_000, 0])
def test_contamination_of_odd_rows(spark, monkeypatch, size):
    """Repeated rows one by one, a very long text whole, no items, no documents, a passage in most of the rows."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
    passage = "one two three four five six seven eight nine ten eleven"
    long = "word " * 200_000 + passage + " word" * 10
    df = docs(spark, long, passage, passage, None, *[f"text {i} " + passage for i in range(40)])
    df = df.union(df.where("doc_id = 1"))
    items = spark.createDataFrame([(1, passage), (2, "x " + passage), (2, passage), (3, "never seen"), (4, "Seven")], "item_id long, text string")
    got = decontaminate.contamination(df, items).select("row.doc_id", "n_words", "starts", "ends", "item_ids").collect()
    rows = {r.doc_id: tuple(r)[1:] for r in got}
    assert len(got) == 45 and rows[0] == (200_021, [200_000], [200_011], [1, 2, 4]) and rows[1] == rows[2] == (11, [0], [11], [1, 2, 4])
    assert rows[3] == (0, [], [], []) and all(rows[i] == (13, [2], [13], [1, 2, 4]) for i in range(4, 44))
    nothing = decontaminate.contamination(df, items.limit(0)).collect()
    assert len(nothing) == 45 and not any(r.starts or r.ends or r.item_ids for r in nothing)
    assert decontaminate.contamination(df.limit(0), items).count() == 0


def test_python_stages_do_not_grow_with_the_items(spark, monkeypatch):
    df = docs(spark, "a b c d e f g h i j k", "x")
    plans = []
    for many in (20, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
        items = spark.range(many).select(F.col("id").alias("item_id"), F.concat(F.lit("a b c d e f g h i j "), F.col("id")).alias("text"))
        plans.append(decontaminate.contamination(df, items)._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
    assert plans == [0, 0]  # all Python stages end in written tables


# --------------------------------------------------------------------------- memory of tasks
_FREED = r"""
import ctypes, re, sys
from logweir.llm import common

def own():
    return int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def run(batches):
    kept = [bytes(1000) for _ in range(100_000)]
    end = bytes(1000)  # lies behind them, so that the allocator can't shrink its top
    ends.append(end)
    yield from batches
    del kept

ends, before = [], own()
assert list(common.tidy(run)(iter([1, 2]))) == [1, 2]
print(own() - before)
"""


def test_tasks_give_freed_memory_back():
    """A worker stays small after a task: in a fresh process, as an allocator's state depends on what ran before."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if sys.platform != "linux" or platform.libc_ver()[0] != "glibc":
        pytest.skip("measured and trimmed with glibc on Linux")
    out = subprocess.run([sys.executable, "-c", _FREED], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=60, check=True)
    assert float(out.stdout) < 30


def test_word_hashes_are_bounded_and_right_when_they_start_over():
    """Remembered words take less than 8 MB of a worker, and a text's set doesn't depend on what is remembered."""
    h = common.WordHashes()
    words = [b"w%d" % i for i in range(3 * h.MOST)]
    got = h.of(words)
    assert len(h) <= h.MOST <= 50_000
    assert (got == np.array([common.xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)).all()
    size = sys.getsizeof(h) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in h.items())
    assert size < 8 << 20


def test_counts_pass_on_within_a_batch():
    """A task counts a bounded number of words, however many one batch has; the sums are those of all texts."""
    texts = [" ".join("w%dx%d" % (i, j) for j in range(2000)) for i in range(60)] + ["w0x0 w1x1"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(60)] + [1])], ["text", "y"])
    parts = list(toxicity._counts(iter([batch])))
    assert len(parts) == 3
    sums = {}
    for token, clean, toxic in zip(*(pa.Table.from_batches(parts).column(c).to_pylist() for c in ("token", "clean", "toxic"))):
        c, t = sums.get(token, (0, 0))
        sums[token] = (c + clean, t + toxic)
    assert len([k for k in sums if k[:1] == b"w"]) == 120_000
    assert sums[b"ww0x0"] == (1, 1) and sums[b"ww1x1"] == (0, 2) and sums[b"ww2x5"] == (1, 0)


# --------------------------------------------------------------------------- quality
def test_statistics():
    h = common.WordHashes()
    text = "a b c d e f a b c d e\nx #y\nx #y\n \n \n"
    got = dict(zip(quality.STATS, quality.statistics_of(text, h)))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (15, 17, 2, 1, 10)
    assert quality.statistics_of(None, h) == quality.statistics_of("", h) == (0,) * len(quality.STATS)


def test_quality_judges(spark):
    rng = random.Random(7)
    good = [" ".join("w%d" % rng.randrange(5000) for _ in range(80)) + "." for _ in range(300)]
    odd = [" ".join("w%d###" % rng.randrange(5000) for _ in range(80)) for _ in range(12)]
    df = docs(spark, *good, *odd, None, "", "too short").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(250)] + [(300 + i, 0) for i in range(8)] + [(None, 0), (1, None)], "doc_id long, quality int")
    got = {r.row.doc_id: r for r in quality.judge(df, labels).collect()}
    assert sum(got[i].kept for i in range(300)) >= 295 and sum(got[i].kept for i in range(300, 312)) <= 1 and not any(got[i].kept for i in (312, 313, 314))
    assert quality.judge(df, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_quality_matches_brute_force(spark):
    """Path lengths node by node, the threshold by trying all, and rates on rows that neither the forest nor the threshold saw."""
    rng = np.random.default_rng(22)
    x, odd = rng.normal(size=(300, 4)), rng.normal(4, 1, size=(9, 4))
    forest = quality.Forest(x, odd, trees=20, sample=64)

    def path(tree, row):
        stat, split, left, right, length = tree
        at = 0
        while stat[at] >= 0:
            at = left[at] if row[stat[at]] < split[at] else right[at]
        return length[at]

    points = np.r_[x[:40], odd]
    want = [2 ** (-np.mean([path(t, p) for t in forest.trees]) / forest.expected) for p in points]
    assert forest.anomaly(points) == pytest.approx(np.array(want))
    harmonic = lambda n: sum(1 / i for i in range(1, n + 1))
    assert forest.average(256) == pytest.approx(2 * harmonic(255) - 2 * 255 / 256, abs=0.01) and forest.average(1) == 0
    for _ in range(200):
        n = rng.integers(2, 30)
        a, good, copies = rng.integers(0, 8, n) / 8, rng.random(n) < 0.7, rng.integers(1, 4, n)
        loss = rng.choice([0.0, 0.1, 0.5])

        def gain(cut):
            hit, lost = (copies * ((a > cut) & ~good)).sum() / max((copies * ~good).sum(), 1), (copies * ((a > cut) & good)).sum() / max((copies * good).sum(), 1)
            return hit - lost if lost <= loss else -1

        cut = quality.threshold(a, good, loss, copies)
        cuts = [v - 1e-9 for v in a]
        best = max(map(gain, cuts))
        assert (cut == np.inf and (best < 0 or good.all() or not good.any())) or gain(cut) == pytest.approx(best)
    texts = [" ".join("w%d" % rng.integers(5000) for _ in range(80)) + "." for _ in range(900)] + [" ".join("w%d%s" % (rng.integers(5000), "##" * rng.integers(0, 2)) for _ in range(80)) for _ in range(60)]
    df, labels = docs(spark, *texts), [(i, int(i < 900)) for i in range(960)]
    known = spark.createDataFrame([r for r in labels if r[0] % 3], "doc_id long, quality int")
    got = {r.row.doc_id: r.kept for r in quality.judge(df, known).collect()}
    unseen = [i for i, _ in labels if i % 3 == 0]
    assert sum(not got[i] for i in unseen if i >= 900) >= 18 and sum(not got[i] for i in unseen if i < 900) <= 9
    assert quality.judge(df.limit(0), known).count() == 0


def test_quality_sample_with_one_key_in_most_rows(spark):
    rng = random.Random(11)
    texts = [" ".join("w%d" % rng.randrange(5000) for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(k, texts[k]) for k in range(4) for _ in range(100)]
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(60)], "doc_id long, quality int")
    for most in (50, 110, 250):
        assert quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_rows=most).count() == len(rows)
    a, g = np.array([0.9, 0.8, 0.1]), np.array([True, False, True])
    assert quality.threshold(a, g, 0.4, np.array([1, 1, 9])) < 0.8 and quality.threshold(a, g, 0.4) == float("inf")


def test_quality_learns_from_all_labelled_rows(spark):
    """Leaf sizes and the threshold count every labelled row, whatever ``max_rows``; trees draw from all of them."""
    rng = np.random.default_rng(5)
    stats = [(i, 80, int(rng.integers(240, 480)), int(rng.integers(0, 4)) + 40 * (i % 10 == 0), 0, int(rng.integers(0, 12)), i % 10 > 0) for i in range(3000)]
    learn = spark.createDataFrame(stats, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, good boolean").repartition(7)
    x, good = quality.features(np.array([r[1:6] for r in stats])), np.array([r[6] for r in stats])
    forest, whole = quality.fit(learn, 2700, 300), quality.Forest(x[good], x[~good])
    for (stat, split, left, right, path), mine in zip(forest.trees[:5], whole.trees, strict=False):
        assert np.array_equal(stat, mine[0]) and np.array_equal(split, mine[1])
        todo = [(0, 0, np.arange(len(x)))]
        while todo:
            at, depth, rows = todo.pop()
            if stat[at] >= 0:
                below = x[rows, stat[at]] < split[at]
                todo += [(left[at], depth + 1, rows[below]), (right[at], depth + 1, rows[~below])]
                continue
            size = 254 * good[rows].sum() / 2700 + 2 * (~good[rows]).sum() / 300
            low = int(size)
            want = forest.average(low) + (size - low) * (forest.average(low + 1) - forest.average(low))
            assert path[at] == pytest.approx(depth + want)
    copies = rng.integers(1, 4, 3000)
    anomaly = forest.anomaly(x).round(2)
    judged = spark.createDataFrame([(float(a), bool(g), int(c)) for a, g, c in zip(anomaly, good, copies)], "anomaly double, good boolean, copies long")
    for loss in (0.0, 0.005, 0.3):
        want = quality.threshold(anomaly, good, loss, copies)
        assert [quality.table_threshold(judged, loss, most) for most in (3, 5000)] == [want, want] and want < 1
    assert quality.table_threshold(judged.where("good"), 0.1, 3) == float("inf")
    texts = [" ".join("w%d%s" % (rng.integers(5000), "#" * int(i % 9 == 0 and rng.integers(0, 2))) for _ in range(60)) for i in range(300)]
    known = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(300)], "doc_id long, quality int")
    few, all_ = (sorted((r.row.doc_id, r.anomaly, r.kept) for r in quality.judge(docs(spark, *texts), known, max_rows=most).collect()) for most in (10, 50_000))
    assert few == all_ and 10 < sum(not r[2] for r in all_) < 60


# --------------------------------------------------------------------------- mixing
def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 40))), s) for i, s in enumerate(rng.choice(["a", "b", "c", None, "tiny"]) if k else "hot" for k in [rng.randrange(3) for _ in range(600)])]
    rows += [(1000, None, "a"), (1001, "", "void"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.choose(df).collect()
    again = mixing.choose(df.repartition(3)).collect()
    key = lambda r: (r.source or "", r.doc_id, r.positions)
    assert len(got) == len(rows) and sorted(map(key, got)) == sorted(map(key, again))
    assert all(0 <= p <= 1 for r in got for p in r.positions) and all(len(r.positions) <= 3 for r in got)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        size, taken, target = by.get(r.source, (0, 0, 0))
        by[r.source] = (size + r.size, taken + r.size * len(r.positions), r.target)
    assert sum(t for _, _, t in by.values()) == pytest.approx(total)
    for size, taken, target in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= max(2, 0.02 * target)
    taken = mixing.occurrences(df)
    assert taken.columns == df.columns and taken.count() == sum(len(r.positions) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_numbers_occurrences_by_training_time(spark):
    """Ranks are the places in a sort of all training times, and the pipeline's rows stand in that order."""
    rng = random.Random(10)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(30))), "abc"[i % 3]) for i in range(150)] + [(5, "twice", "a"), (5, "twice", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit("clash"))
    each = sorted((p, r.digest, e, r.doc_id) for r in mixing.choose(df).collect() for e, p in enumerate(r.positions))
    got = mixing.mix(df).collect()
    place = sorted((int(k), r.doc_id) for r in got for k in r.ranks.split(",") if k)
    assert [k for k, _ in place] == list(range(len(each))) and [d for _, d in place] == [e[3] for e in each]
    assert all(r.taken == r.size * len([k for k in r.ranks.split(",") if k]) and (r.position is None) == (r.ranks == "") for r in got)
    out = common.new_dir(spark, "t")
    mixing.occurrences(df).write.parquet(out)
    stored = spark.read.parquet(out).select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [r.doc_id for r in stored] == [d for _, d in place]


def brute_choice(rows):
    """Words that the mix takes of each (source, digest), document by document."""
    source, out = {}, {}
    for i, t, s in rows:
        mark = hashlib.md5((t or "").encode()).hexdigest()
        source.setdefault(s, []).append((hashlib.md5(f"{i}:{mark}".encode()).hexdigest(), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    names = sorted(source, key=lambda s: (s is None, s))
    size = {s: sum(n for _, n in source[s]) for s in names}
    weight, target, free, left = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names), sum(size.values())
    while over := {s for s in free if 3 * size[s] * sum(weight[x] for x in free) <= weight[s] * left}:
        target |= {s: 3 * size[s] for s in over}
        left, free = left - sum(3 * size[s] for s in over), free - over
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    for s in names:
        full = int(target[s] // size[s]) if size[s] else 0
        missing, todo, first = round(target[s] - full * size[s]), sorted(source[s]), True
        out |= {(s, d): n * full for d, n in todo}
        while True:
            fits = [(d, n) for d, n in todo if 0 < n <= missing]
            fits.sort(key=lambda x: (0 if first else -x[1].bit_length(), x[0]))
            taken, c = [], 0
            for d, n in fits:
                if c + n > missing:
                    break
                taken.append((d, n))
                c += n
            if not taken and not first:
                break
            missing, first, todo = missing - c, False, [x for x in todo if x not in taken]
            for d, n in taken:
                out[s, d] += n
    return out


def test_mix_takes_what_brute_force_takes(spark):
    rng = random.Random(13)
    rows = [(i, "w " * rng.choice([1, 2, 7, 30, 200, 1000]), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows += [(1000 + s, "w " * 20_000, "ab"[s]) for s in range(2)] + [(2000, None, "a"), (2001, "", "empty"), (2002, "x", "one")]
    got = {(r.source, r.digest): r.size * len(r.positions) for r in mixing.choose(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == brute_choice(rows)


def test_mixing_passes_long_documents(spark):
    """A document longer than the gap doesn't keep the others out, wherever its digest stands, and the passes end with nothing that fits."""
    rng = random.Random(9)
    rows = [(1000 * s + i, "w " * (rng.randrange(1, 40) if i else 6000), f"s{s}") for s in range(4) for i in range(300)]
    got = mixing.choose(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        full = int(own[0].target // own[0].source_size)
        missing = own[0].target - sum(r.size * len(r.positions) for r in own)
        assert missing > -1 and not any(len(r.positions) == full and r.size <= missing - 1 for r in own)
        # Training time goes on through the documents that were picked later.
        last = sorted(r.positions[-1] for r in own if len(r.positions) > full)
        assert not last or len(set(last)) > len(last) // 2


def test_running_totals(spark):
    """A key with most of the rows, nulls and ties, over more partitions than rows."""
    rows = [(1, i) for i in range(90)] + [(None, 5), (None, 6), (2, 7)]
    df = spark.createDataFrame(rows, "k int, v int")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {r: (sum(x[1] for x in order[:i]), i) for i, r in enumerate(order)}
    for n in (3, 200):
        got = {(r.k, r.v): (r.s, r.n) for r in common.running_totals(df, [F.col("k"), F.col("v")], {"s": F.col("v"), "n": F.lit(1)}, n).collect()}
        assert got == want
    assert common.running_totals(df.limit(0), [F.col("k")], {"s": F.col("v")}).count() == 0


def test_positions_invert_demand(spark):
    for g in (-0.5, 0.0, 0.5):
        t = spark.range(11).select((F.col("id") / 10).alias("u")).select("u", mixing.position(F.col("u"), F.lit(g)).alias("t")).collect()
        assert all(r.t + g * (r.t**2 - r.t) == pytest.approx(r.u) for r in t)


def test_encoder_keeps_pieces_that_come_again(monkeypatch):
    """A full memory lets go of what came once, not of what comes in every slice, and the ids stay the tokenizer's."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens.Encoder, "MOST_PIECES", 600)
    own, plain, rng = tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), random.Random(3)
    common_words, learnt = [f"word{i}s." for i in range(40)], []
    monkeypatch.setattr(own, "_learn", lambda simple, words: (learnt.extend(simple + words), tokens.Encoder._learn(own, simple, words))[1])
    for k in range(30):
        texts = [" ".join(["x", *rng.sample(common_words, 30), f"{rng.randrange(10**9)}q", f"{k}\n{rng.random()}", "<|x|>"]) for _ in range(25)]
        ids, n = own.encode(pa.array(texts), 2)
        want = [[*e.ids, 2] for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(own.known) < 900
    assert all(learnt.count(w) == 1 for w in common_words)
    for _ in range(3):  # all of them come again: nothing to tell them apart, the memory starts over and stays bounded
        many = [" ".join(["x", *(f"a{i}" for i in range(at, at + 200))]) for at in range(0, 1000, 200)]
        assert own.encode(pa.array(many), 2)[0].tolist() == [i for e in plain.encode_batch(many, add_special_tokens=False) for i in [*e.ids, 2]]
        assert len(own.known) <= 1800


def test_long_texts_reach_the_encoder_in_small_batches(spark, monkeypatch):
    """The token writer's tasks get some 2 MB at once, not 10,000 rows, and the session's setting is what it was, after an error too."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)

    def write(df, what):
        if what == "manifest":
            rows = df.sparkSession.range(0, 4000, 1, 1).select(F.expr("repeat('abcdefgh', 500)").alias("text"))
            seen.extend(r.n for r in rows.mapInArrow(sizes, "n long").collect())
            raise RuntimeError("stop")

    monkeypatch.setattr(tokens, "materialize", write)
    with pytest.raises(RuntimeError, match="stop"):
        tokens.write_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_path(), common.new_dir(spark, "t"), distinct=True)
    assert sum(seen) == 4000 and max(seen) < 1000
    assert spark.conf.get(name) == before
