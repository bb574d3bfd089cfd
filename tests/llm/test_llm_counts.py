"""Token counts of prefixes, phrases and spelling variants: brute force and odd rows."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweir.llm import phrases, token_counts, variants
from logweir.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --------------------------------------------------------------------------- token counts
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def brute_prefixes(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "b", "the", " ", "  ", "\n", "\r\n", "\t", ".", ",", "'s", "'re", "'ll", "'", "é", "中", "文", " ", "1", "23", "😀", "<|endoftext|>", "<|end", "!!", "don't", "ing", "́", "  \n", " ", "---", "_", "Ünï", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_every_prefix_is_exact(library):
    texts = [*odd_texts(400), "", None, " ", "  ", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "x" * 300, "-" * 200, "we'll they've you're I'll '", " 're x're !'ll"]
    steps, n = token_counts.PrefixCounter(tokenizer_path()).steps(pa.array(texts, pa.string()))
    for text, s, k in zip(texts, steps, n.tolist(), strict=True):
        want = brute_prefixes(library, text or "")
        assert token_counts.prefix_counts(s).tolist() == want and k == want[-1], text


def test_new_words_are_worked_out_together(library, monkeypatch):
    """Distinct plain pieces take no step of their own, and their counts are those of every prefix."""
    rng = random.Random(12)
    parts = ["the", "ing", "Sch", "é", "ñado", "ß", "ÿ", "x", "Qu", "ation"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", "%%%", ",'", ".\n" + rng.choice(parts), "\n" + rng.choice(parts) + "!"])
    texts = [" ".join(word() for _ in range(40)) for _ in range(60)] + ["\0", "a \0 b", "\0\n", "a\0\nb \0\nc", "é" * 64, "b " + "é" * 63 + " " + "é" * 64 + " c"]
    own, calls = token_counts.PrefixCounter(tokenizer_path()), []
    own.AT_ONCE = 50
    prefixes = own.prefixes
    monkeypatch.setattr(own, "prefixes", lambda p: calls.append(p) or prefixes(p))
    first, _ = own.steps(pa.array(texts[:60]))
    assert not calls
    own.MOST_PAIRS = 40
    for text, s in zip(texts, first + own.steps(pa.array(texts[60:]))[0], strict=True):
        assert token_counts.prefix_counts(s).tolist() == brute_prefixes(library, text), text
    own.MOST_PIECES = 0
    assert own.steps(pa.array(texts[:60]))[0] == first


def test_long_texts_are_cut_where_it_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN", 40)
    own = token_counts.PrefixCounter(tokenizer_path())
    own.MOST_PIECES = 50  # what is remembered starts over
    texts = ["".join(odd_texts(8, seed)) for seed in range(30)] + ["word  other\n more, " * 12, "y" * 500]
    steps, n = own.steps(pa.array(texts))
    for text, s in zip(texts, steps):
        assert token_counts.prefix_counts(s).tolist() == brute_prefixes(library, text)


def test_token_counts_answer_questions(spark, library):
    """Odd rows, clashing columns, and budgets: the stored counts say what encoding again would."""
    texts = [*odd_texts(40, 7), None, "", "same text here", "same text here", "word " * 30_000]
    rows = [(None if i == 3 else i % 30, t, 1, "row") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, row string").repartition(3)
    got = token_counts.store_counts(df, tokenizer_path())
    found = sorted(((r.row.doc_id, r.row.text, r.n_bytes, r.n_tokens, r.row.n_tokens) for r in got.collect()), key=str)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert found == sorted(((i, t, len((t or "").encode()), count(t), 1) for i, t, _, _ in rows), key=str)
    for budget in (0, 1, 7, 1024):
        for r in token_counts.longest_within(got, F.lit(budget)).collect():
            text = r.row.text or ""
            if len(text) < 500:
                assert r.fits == max(i for i, c in enumerate(brute_prefixes(library, text)) if c <= budget)
            else:
                assert count(text[: r.fits]) <= budget < count(text[: r.fits + 1])
    for r in token_counts.tokens_of_prefix(got, F.coalesce(F.length("row.text"), F.lit(0)) / 2).collect():
        assert r.prefix_tokens == count((r.row.text or "")[: len(r.row.text or "") // 2])
    assert token_counts.store_counts(df.limit(0), tokenizer_path()).count() == 0


def test_only_plain_byte_level_tokenizers():
    import public_tokenizers

    with pytest.raises(ValueError, match="no plain byte-level"):
        token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


# --------------------------------------------------------------------------- phrases
def brute_collocations(rows, longest, least, most):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        rows = []
        for w, a in found.items():
            score, _, l, r = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            longer = [b for v, b in found.items() if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                rows.append((-score, -a, " ".join(w).encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most])}
    return out


def test_phrases_match_brute_force(spark):
    """Nulls, ties, repeats, separators, other languages, a phrase in a third of all rows and one very long text."""
    rng = random.Random(5)
    words = ["New", "york", "ÉTÉ", "the", "of", "a", "b", "c", "\xa0", "e\u0301", "中", "hot", "dog", "hot dog stand", "\x1c"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", ":", ";x", "\x0b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))
    rows = [(text(rng.randrange(0, 40)), rng.choice(["en", "fr", None, "und", ""])) for _ in range(150)] + [("hot dog stand of", "en")] * 80 + [(None, "en"), ("", None), (" .,\n", "de"), (text(20_000), "fr")]
    df = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, w1 string, n int").repartition(5)
    for longest, least, most in ((4, 30, 2000), (3, 3, 7), (2, 300, 5)):
        got = {tuple(r) for r in phrases.collocations(df, longest, least, most).collect()}
        assert got == brute_collocations(rows, longest, least, most) and got
    assert phrases.collocations(df.limit(0)).count() == 0


def test_phrase_buckets_that_collide_only_admit_more(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(" ".join(f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(60)), "en") for _ in range(120)] + [(" ".join(f"x{rng.randrange(400)}" for _ in range(20_000)), "de")]
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "HELD", 500)
    assert phrases.window_counts(df, 4, 5).count() < phrases.window_counts(df, 4, 5, bits=16).count()
    got = {tuple(r) for r in phrases.collocations(df, 4, 5, 50, bits=16).collect()}
    assert got == brute_collocations(rows, 4, 5, 50)


def test_phrase_scores_beyond_64_bits(spark):
    huge = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", ["a", "b"], huge), ("en", ["a"], huge + 1), ("en", ["b"], huge + 3), ("en", [], 4 * huge)], "lang string, words array<string>, f long")
    assert [tuple(r)[3:] for r in phrases.score_phrases(counts).collect()] == [(huge, huge + 1, huge + 3, 2_000_000 * huge // (2 * huge + 4))]


# --------------------------------------------------------------------------- spelling variants
def brute_variants(rows, least, often, ratio):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    edit = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))
    near = {a: [b for b in n if edit(a, b) or edit(b, a)] for a in n}
    form = {}
    for a in n:
        if near[a]:
            best = min(near[a], key=lambda b: (-n[b], b))
            if n[best] >= ratio * n[a]:
                form[a] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, k, len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w, k in n.items()}


def test_variants_match_brute_force(spark):
    """Families around a word, chains of forms, letters that only move, Latin letters, slips, ties, repeats, nulls, long texts."""
    rng = random.Random(8)
    letters = "abcdeéÿà×"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aabbcc", "abcabc", "aabbcd"]

    def altered(w):
        i, c = rng.randrange(len(w) + 1), rng.choice(letters)
        return rng.choice([w[:i] + c + w[i:], w[: i - 1] + c + w[i:] if i else c + w[1:], w[:i] + w[i + 1 :]])

    words = bases + [altered(w) for w in bases for _ in range(6)] + [altered(altered(w)) for w in bases for _ in range(3)] + ["".join(rng.sample(w, len(w))) for w in bases]
    weight = [rng.choice([1, 2, 6, 40, 250]) for _ in words]
    pick = lambda k: rng.choice([" ", ", ", "1", "\n", "_"]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weight, k=k))
    rows = [(None if i == 5 else i % 90, pick(rng.randrange(0, 80))) for i in range(100)] + [(500, pick(6_000)), (501, None), (502, ""), (503, "z" * 20_000 + " " + "Ab" * 4)]
    rows += [rows[7]] * 3
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    for least, often, ratio in ((6, 5, 5), (4, 1, 2), (7, 3, 1_000)):
        got = [tuple(r) for r in variants.spelling_variants(df, least, often, ratio).select("word", "n", "n_near", "form", "form_n", "root").collect()]
        want = brute_variants(rows, least, often, ratio)
        assert len(got) == len(want) and set(got) == want
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_roots_of_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}" if i < 40 else None) for i in range(41)], "word string, form string")
    assert {tuple(r) for r in variants.follow_forms(chain).collect()} == {(f"w{i:03}", "w040") for i in range(40)}
