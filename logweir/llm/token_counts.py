"""Exact token counts of every prefix of a text, stored, so that truncation and budget questions need no second encoding.

Prefix dynamic programming over byte-pair encodings: a token sequence is an encoding exactly if each two neighbours in it
are the encoding of their joined bytes.  So of all tokens that end at a byte, one follows on the last token of the prefix before
it, and ``count[i] = count[i - its length] + 1``.  The tokens that end at each byte come from one automaton over the
vocabulary, and whether two tokens may stand together is worked out once and remembered; a text of n bytes takes some 4 n steps,
however long its words are.  New short pre-tokens go through the same steps together, byte by byte as numpy columns.

Pre-tokens are the tokenizer's own.  A text is cut before every single space that a visible character follows, where a pre-token
begins whatever stands around it; such pieces repeat, so each distinct one is worked out once and the counts of whole
batches are gathered by Arrow and numpy.

The stored form of a text is ``steps``, one signed byte per code point: the difference between the count with and without
that code point (adding a character may lower a count, as tokens merge).  Running sums give every prefix's count.

Defined cases: null and empty texts have no tokens and no steps.  A special token's string inside a text is that one token from its last
character on, and ordinary text before, as the library encodes such a prefix.  Rows are kept as they are: repeats,
null ids and any other columns, inside ``row``.  Texts of any length are taken whole, cut into runs of ``RUN`` characters where
that changes nothing.  An empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import repeat
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, texts_of
from .tokens import gathered, slices

#: Runs into which longer texts are cut, in characters.
RUN = 4 << 20
# Code points with Unicode's property White_Space.
_BLANK = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CUT = re.compile(f" (?=[^{_BLANK}])")
_BLANKS = re.compile(f"[{_BLANK}]+")
#: Pre-tokens for certain: letters, punctuation behind them, and the same again after a line break.
_LETTERS, _MARKS = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+", r"[!-/:-@\[-`{-~]"
_PLAIN = re.compile(rf" ?{_LETTERS}{_MARKS}*(?:\n{_LETTERS}{_MARKS}*)*")
_PARTS = re.compile(rf" ?{_LETTERS}|{_MARKS}+|\0?\n")
#: Of the pre-tokenizer's contractions those of three characters.
_CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write a byte: printable ones as themselves, the others as letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Counts of prefixes under one byte-level BPE tokenizer, with remembered pieces."""

    MOST_PIECES, MOST_PAIRS, LONGEST, AT_ONCE = 500_000, 2_000_000, 64, 20_000
    #: Stands for the space behind a piece among pre-tokens; it is none itself, as white space ends one.
    GAP = "\0\n"

    def __init__(self, path: str) -> None:
        import ahocorasick

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.pretokens, self.merged = library.pre_tokenizer.pre_tokenize_str, library.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE" and not spec["normalizer"]
        if not plain or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        odd = [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if odd:
            raise ValueError(f"{path} has added tokens that take in text around them: {odd}")
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.bytes_of = {model["vocab"][t]: b for t, b in raw.items()}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.written = {model["vocab"][t]: t for t in raw}
        self.endings = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) > 1:
                self.endings.add_word(b.decode("latin-1"), (len(b), i))
        self.endings.make_automaton()
        self.byte_token = np.array([self.single[b] for b in range(256)], np.int64)
        # The vocabulary's beginnings by length: parent's place << 8 | byte, in order, and the token that ends there or -1.
        self.beginnings: list[tuple[np.ndarray, np.ndarray]] = []
        ids, places, most = {b: i for i, b in self.bytes_of.items()}, {b"": 0}, 2 * self.LONGEST
        for n in range(1, min(most, max(map(len, ids))) + 1):
            found = sorted({b[:n] for b in ids if len(b) >= n})
            self.beginnings.append((np.array([places[b[:-1]] << 8 | b[-1] for b in found], np.int64), np.array([ids.get(b, -1) for b in found], np.int64)))
            places = {b: i for i, b in enumerate(found)}
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_fits = np.empty(0, np.int64), np.empty(0, bool)
        self._forget()

    # ------------------------------------------------------------------ two tokens
    def _stand(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: begin a pre-token): the model merges their joined bytes to just them."""
        got = self.merged(self.written.get(before, "") + self.written[token])
        return [t.id for t in got] == ([token] if before < 0 else [before, token])

    def _fits(self, before: int, token: int) -> bool:
        """:meth:`_stand`, remembered."""
        if len(self.pairs) >= self.MOST_PAIRS:
            self.pairs.clear()
        self.pairs[before << 20 | token] = known = self._stand(before, token)
        return known

    @staticmethod
    def _found(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``sought`` in the ordered ``keys``, and whether they are there."""
        at = np.minimum(np.searchsorted(keys, sought), max(len(keys) - 1, 0))
        return at, keys[at] == sought if len(keys) else np.zeros(len(sought), bool)

    def _fit_all(self, pairs: np.ndarray, fresh: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """:meth:`_stand` of pairs ``before << 20 | token``; ``fresh`` has the ones worked out since the last merge."""
        at, known = self._found(self.pair_keys, pairs)
        fits = np.zeros(len(pairs), bool)
        fits[known] = self.pair_fits[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            sought = pairs[rest]
            new = np.unique(sought[~self._found(fresh[0], sought)[1]])
            if len(new):
                stand = np.fromiter((self._stand(k >> 20, k & (1 << 20) - 1) for k in new.tolist()), bool, len(new))
                to = np.searchsorted(fresh[0], new)
                fresh = np.insert(fresh[0], to, new), np.insert(fresh[1], to, stand)
            fits[rest] = fresh[1][self._found(fresh[0], sought)[0]]
        return fits, fresh

    # ------------------------------------------------------------------ many pre-tokens
    def _learn(self, names: list[str]) -> None:
        """:meth:`prefixes` of many new pre-tokens at once, of at most ``LONGEST`` characters below U+0800.

        Longest first, so those with a byte at some place are the first ones: all bytes, last tokens and counts are kept place by
        place, ``off[i]`` on for what ends with byte i, and a place is worked out for all pre-tokens together.
        """
        raw = list(map(str.encode, names))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-size, kind="stable")
        size, names, raw = size[order], [names[i] for i in order.tolist()], [raw[i] for i in order.tolist()]
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(size) - size
        many = np.searchsorted(-size, -np.arange(size[0] + 1), "right")
        off = np.r_[0, np.cumsum(many)]
        at = np.zeros(off[-1], np.int64)
        for i in range(1, size[0] + 1):
            at[off[i] : off[i + 1]] = data[begin[: many[i]] + i - 1]
        # Every token that ends somewhere: from each place down the vocabulary's beginnings.
        start = np.repeat(np.arange(size[0]), many[1:])
        which = np.arange(off[-1] - off[1]) - np.repeat(off[1:-1] - off[1], many[1:])
        node = at[off[1] :]
        ends = []
        for n, (keys, tokens) in enumerate(self.beginnings[1:], 2):
            go = np.flatnonzero(size[which] >= start + n)
            start, which = start[go], which[go]
            node, there = self._found(keys, node[go] << 8 | at[off[start + n] + which])
            start, which, node = start[there], which[there], node[there]
            if not len(node):
                break
            token = tokens[node]
            is_token = token >= 0
            ends.append(np.stack([start[is_token] + n, off[start[is_token]] + which[is_token], off[start[is_token] + n] + which[is_token], token[is_token]]))
        place, since, end, token = np.concatenate(ends, 1) if ends else np.empty((4, 0), np.int64)
        order = np.argsort(place, kind="stable")
        since, end, token, bounds = since[order], end[order], token[order], np.searchsorted(place[order], np.arange(size[0] + 2))
        last, count = self.byte_token[at], np.zeros(off[-1], np.int64)
        last[: off[1]] = -1
        fresh = np.empty(0, np.int64), np.empty(0, bool)
        for i in range(1, size[0] + 1):
            # Where no longer token fits, it is that of the byte.
            count[off[i] : off[i + 1]] = count[off[i - 1] : off[i - 1] + many[i]] + 1
            own = slice(bounds[i], bounds[i + 1])
            fits, fresh = self._fit_all(last[since[own]] << 20 | token[own], fresh)
            to = end[own][fits]
            last[to], count[to] = token[own][fits], count[since[own][fits]] + 1
        if len(self.pair_keys) + len(fresh[0]) > self.MOST_PAIRS:
            self.pair_keys, self.pair_fits = fresh
        else:
            to = np.searchsorted(self.pair_keys, fresh[0])
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, to, fresh[0]), np.insert(self.pair_fits, to, fresh[1])
        # One after the other again, by code points.
        whole = np.r_[data[1:] & 0xC0 != 0x80, True]
        counts = count[off[np.arange(len(data)) - np.repeat(begin, size) + 1] + np.repeat(np.arange(len(size)), size)]
        until = np.cumsum(np.add.reduceat(whole, begin, dtype=np.int64))
        steps = np.diff(counts[whole], prepend=0)
        steps[until[:-1]] = counts[whole][until[:-1]]
        if len(steps) and np.abs(steps).max() > 127:
            raise OverflowError("a step that a byte doesn't hold")
        self.pretoken.update(zip(names, range(len(self.pre_first), len(self.pre_first) + len(names))))
        n = np.diff(until, prepend=0)
        for column, values in ((self.pre_first, len(self.pre_pool) + until - n), (self.pre_size, n), (self.pre_count, counts[begin + size - 1])):
            column.frombytes(values.astype(np.int64).tobytes())
        self.pre_pool += steps.astype(np.int8).tobytes()

    # ------------------------------------------------------------------ one pre-token

    def prefixes(self, pretoken: str) -> tuple[bytes, int]:
        """Steps of a pre-token's prefixes, by code points, and its number of tokens; remembered."""
        i = self.pretoken.get(pretoken)
        if i is not None:
            return bytes(self.pre_pool[self.pre_first[i] : self.pre_first[i] + self.pre_size[i]]), self.pre_count[i]
        data = pretoken.encode()
        pairs, fits, size, own = self.pairs, self._fits, len(data), 0
        last, count = [-1, *map(self.single.__getitem__, data)], [0] * (size + 1)
        done = 0
        for end, (n, token) in self.endings.iter(data.decode("latin-1")):
            end += 1
            if end <= done:
                continue
            while done < end - 1:  # where no longer token fits, it is that of the byte
                done += 1
                count[done] = count[done - 1] + 1
            before = last[end - n]
            known = pairs.get(before << 20 | token)
            if known or known is None and fits(before, token):
                last[end], count[end] = token, count[end - n] + 1
                done = end
        while done < size:
            done += 1
            count[done] = count[done - 1] + 1
        own = count[-1]
        if size != len(pretoken):
            count = [0, *(count[i] for i in range(1, size + 1) if i == size or data[i] & 0xC0 != 0x80)]
        steps = array("b", map(sub, count[1:], count)).tobytes()  # a step that a byte doesn't hold is an error
        if len(pretoken) <= self.LONGEST:
            self._keep(pretoken, steps, own)
        return steps, own

    # ------------------------------------------------------------------ one piece
    def piece(self, text: str) -> tuple[bytes, int, int]:
        """Steps of a piece; its number of tokens; and how many more it has with a space behind it."""
        out, base, at, more = [], 0, 0, 0
        for _, (start, end) in self.pretokens(text):
            if start < at:
                continue  # in a run of white space that is done
            blank = _BLANKS.match(text, start)
            if blank and blank.end() > end:
                # Cut off within it, a run of white space is one pre-token; before visible text its last character stands apart.
                at = blank.end()
                steps, own = self.prefixes(text[start:at])
                n = self.prefixes(text[start : at - 1])[1] + self.prefixes(text[at - 1])[1]
                out.append(steps)
                base, more = base + n, n - own
                continue
            steps, own = self.prefixes(text[start:end])
            if text[start:end] in _CONTRACTIONS:
                steps = array("b", (1, 1, own - 2)).tobytes()  # without its last letter it is an apostrophe and a letter
            if more:
                steps, more = array("b", (steps[0] + more, *array("b", steps[1:]))).tobytes(), 0
            out.append(steps)
            base, at = base + own, end
        rest = text[len(text.rstrip(_BLANK)) :]
        gap = self.prefixes(rest + " ")[1] - self.prefixes(rest)[1] if rest else 1
        return b"".join(out), base, gap

    # ------------------------------------------------------------------ many texts
    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.openings: dict[str, int] = {}
        self.pool, self.pre_pool = bytearray(), bytearray()
        self.first, self.size, self.count, self.gap = (array("q") for _ in range(4))
        self.pretoken: dict[str, int] = {}
        self.pre_first, self.pre_size, self.pre_count = (array("q") for _ in range(3))
        self._keep(self.GAP, b"\1", 0)

    def _keep(self, pretoken: str, steps: bytes, own: int) -> None:
        self.pretoken[pretoken] = len(self.pre_first)
        self.pre_first.append(len(self.pre_pool)), self.pre_size.append(len(steps)), self.pre_count.append(own)
        self.pre_pool += steps

    def _add_all(self, opening: bool, words: list[str]) -> None:
        """Remember new pieces: the steps from the second character on, where it has a space before it, and that of the space behind it."""
        plain, other = [], []
        for word in words:
            text = word if opening else " " + word
            (plain if len(text) <= self.LONGEST and _PLAIN.fullmatch(text) else other).append(text)
        known, skip = (self.openings, 0) if opening else (self.known, 1)
        if plain:
            # Each is its pre-tokens' steps and that of the gap, one token.
            parts = _PARTS.findall(self.GAP.join(plain) + self.GAP)
            new = list(set(parts) - self.pretoken.keys())
            for at in range(0, len(new), self.AT_ONCE):
                self._learn(new[at : at + self.AT_ONCE])
            of = np.fromiter(map(self.pretoken.__getitem__, parts), np.int64, len(parts))
            begin = np.r_[0, np.flatnonzero(of == self.pretoken[self.GAP])[:-1] + 1]
            first, size, count = (np.frombuffer(c, np.int64)[of] for c in (self.pre_first, self.pre_size, self.pre_count))
            first[begin] += skip
            size[begin] -= skip
            n = np.add.reduceat(size, begin)
            known.update(zip([t[skip:] for t in plain], range(len(self.first), len(self.first) + len(plain))))
            for column, values in ((self.first, len(self.pool) + np.cumsum(n) - n), (self.size, n), (self.count, np.add.reduceat(count, begin)), (self.gap, np.ones(len(n), np.int64))):
                column.frombytes(values.astype(np.int64).tobytes())
            self.pool += gathered(np.frombuffer(self.pre_pool, np.int8), first, size).tobytes()
        for text in other:
            steps, own, gap = self.piece(text)
            kept = steps[skip:] + gap.to_bytes(1, "little", signed=True)
            known[text[skip:]] = len(self.first)
            self.first.append(len(self.pool)), self.size.append(len(kept)), self.count.append(own), self.gap.append(gap)
            self.pool += kept

    def _runs(self, texts: pa.Array) -> tuple[list[str], list[tuple[int, int, int]]]:
        """Ordinary runs of text; of each the text it belongs to, the length whose steps count and whether a special token ends it."""
        found = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        runs: list[str] = []
        of: list[tuple[int, int, int]] = []

        def add(i: int, text: str, special: str) -> None:
            at = 0
            while len(text) - at > RUN:
                cut = next((m.start() for m in _CUT.finditer(text, at + RUN) if text[m.start() - 1] not in _BLANK), 0)
                if not cut:
                    break
                runs.append(text[at:cut]), of.append((i, cut - at, 0))
                at = cut
            runs.append(text[at:] + special[:-1]), of.append((i, len(text) - at + len(special), len(special)))

        for i, text in enumerate(texts.to_pylist()):
            at = 0
            for m in found.finditer(text) if found else ():
                add(i, text[at : m.start()], m[0])
                at = m.end()
            add(i, text[at:], "")
        return runs, of

    def _ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps of all texts one after the other, the number of each text's (its length) and its tokens; no special tokens."""
        if len(self.first) > self.MOST_PIECES:
            self._forget()
        lists = self._pieces(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words, of = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        start = offsets[:-1]
        code = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        later = np.ones(len(of), bool)
        later[start] = False
        new = np.flatnonzero((code < 0) & (np.bincount(of[later], minlength=len(words)) > 0))
        added = [words[i] for i in new.tolist()]
        self._add_all(False, added)
        code[new] = np.fromiter(map(self.known.__getitem__, added), np.int64, len(added))
        pieces = code[of]
        opening = [words[i] for i in of[start].tolist()]
        self._add_all(True, [w for w in dict.fromkeys(opening) if w not in self.openings])
        pieces[start] = [self.openings[w] for w in opening]
        first, size, count, more = (np.frombuffer(a, np.int64) for a in (self.first, self.size, self.count, self.gap))
        n = size[pieces]
        ends = offsets[1:] - 1
        n[ends] -= 1  # no space behind the last piece
        steps = gathered(np.frombuffer(self.pool, np.int8), first[pieces], n)
        # A piece counts from a space that is a token of its own; where white space stands before it, it isn't always.
        gap = more[pieces] - 1
        gap[ends] = 0
        odd = np.flatnonzero(gap)
        steps[(np.cumsum(n) - n)[odd + 1]] -= gap[odd].astype(np.int8)
        return steps, np.add.reduceat(n, start), np.add.reduceat(count[pieces], start)

    @staticmethod
    def _pieces(texts: pa.Array) -> pa.ListArray:
        """Texts cut at single spaces before visible characters; the space is dropped."""
        odd = pc.match_substring_regex(texts, r" ([\s\x0B\x1C-\x1F\x{85}\p{Z}]|\z)")
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " ")
        where = odd.to_numpy(zero_copy_only=False)
        cut = pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        order = np.empty(len(texts), np.int64)
        order[~where], order[where] = np.arange((~where).sum()), (~where).sum() + np.arange(where.sum())
        return pa.concat_arrays([pc.split_pattern(texts.filter(pc.invert(odd)), " "), cut]).take(pa.array(order))

    def steps(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """The stored form and the number of tokens of each text."""
        texts = texts.fill_null("")
        if not len(texts):
            return [], np.zeros(0, np.int64)
        hard = pc.greater(pc.utf8_length(texts), RUN)
        for s in self.special:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        where = hard.to_numpy(zero_copy_only=False)
        if not where.any():
            steps, n, tokens = self._ordinary(texts)
            ends = np.cumsum(n)
            body = steps.tobytes()
            return [body[a:b] for a, b in zip((ends - n).tolist(), ends.tolist())], tokens
        body, tokens = [b""] * len(texts), np.zeros(len(texts), np.int64)
        easy = np.flatnonzero(~where)
        found, n = self.steps(texts.take(pa.array(easy))) if len(easy) else ([], np.zeros(0, np.int64))
        for i, b in zip(easy.tolist(), found):
            body[i] = b
        tokens[easy] = n
        for i in np.flatnonzero(where).tolist():
            parts: list[np.ndarray] = []
            runs, about = self._runs(texts.slice(i, 1))
            for run, (_, length, special) in zip(runs, about):
                own = self._ordinary(pa.array([run], pa.string()))[0] if run else np.zeros(0, np.int8)
                if special:
                    # With its last character the special token is one, whatever its letters were before.
                    before = int(own[: length - special].sum(dtype=np.int64))
                    own = np.r_[own, np.int8(before + 1 - int(own.sum(dtype=np.int64)))]
                parts.append(own)
            joined = np.concatenate(parts).astype(np.int8)
            body[i], tokens[i] = joined.tobytes(), int(joined.sum(dtype=np.int64))
        return body, tokens


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker process's counter: a worker runs many tasks, and pieces come again."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            texts = texts_of(b)
            for lo, hi in slices(texts):
                steps, n = own.steps(texts.slice(lo, hi - lo))
                size = pc.fill_null(pc.binary_length(texts.slice(lo, hi - lo)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), size, pa.array(n), pa.array(steps, pa.binary())], ["row", "n_bytes", "n_tokens", "steps"])

    return run


def count_prefixes(docs: DataFrame, tokenizer_path: str, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``carry``, all), ``n_bytes``, ``n_tokens`` and ``steps`` of each row of ``docs``, to be stored."""
    rows = packed(docs, carry)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_count(tokenizer_path), f"row {kind}, n_bytes long, n_tokens long, steps binary")


def store_counts(docs: DataFrame, tokenizer_path: str, carry: list[str] | None = None) -> DataFrame:
    """:func:`count_prefixes`, written to shared storage and read from there; ``steps`` is read only where it is asked for."""
    return materialize(count_prefixes(docs, tokenizer_path, carry), "counts")


def prefix_counts(steps: bytes) -> np.ndarray:
    """Number of tokens of every prefix, from the empty one on."""
    return np.r_[0, np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)]


def _answer(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for steps, asked in zip(b.column("steps"), b.column("asked").to_pylist()):
                counts = prefix_counts(steps.as_buffer().to_pybytes())
                if asked is None:
                    out.append(None)
                elif kind == "tokens":
                    out.append(int(counts[min(max(asked, 0), len(counts) - 1)]))
                else:
                    within = np.flatnonzero(counts <= asked)
                    out.append(int(within[-1]) if len(within) else 0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.int64())], ["row", "answer"])

    return run


def _asked(counted: DataFrame, asked, kind: str, name: str) -> DataFrame:
    names = [c for c in counted.columns if c != "steps"]
    rows = counted.select(F.struct(*names).alias("row"), "steps", asked.cast("long").alias("asked"))
    found = rows.mapInArrow(_answer(kind), f"row {rows.schema['row'].dataType.simpleString()}, answer long")
    return found.select("row.*", F.col("answer").alias(name))


def tokens_of_prefix(counted: DataFrame, length) -> DataFrame:
    """Add ``prefix_tokens``, the tokens of the first ``length`` (a column) code points; texts aren't read."""
    return _asked(counted, length, "tokens", "prefix_tokens")


def longest_within(counted: DataFrame, budget) -> DataFrame:
    """Add ``fits``, the code points of the longest prefix with at most ``budget`` (a column) tokens; texts aren't read."""
    return _asked(counted, budget, "fits", "fits")
