"""Operator 2: exact token counts at every prefix of a text, by dynamic programming.

The tokenizer is a byte-level BPE with word ends (``word_bpe_49k.json``). In a
BPE encoding each pair of neighbouring tokens is one that the merges leave
alone, and such a sequence is unique. So the encoding of a prefix ending at i is
the encoding of a shorter prefix plus one last token that fits behind it, and

    count[i] = count[i - len(last token)] + 1

gives the counts of all prefixes of a word in one pass. A word that is cut takes
the word-end form of its last token; a prefix of a text is the words before
plus a cut word. Words repeat, so their profiles are kept in the Python worker.

Edge cases: null counts as empty; an empty text has the one prefix of length 0
with 0 tokens; strings of special tokens inside a text are one token, as the
library has it by default; texts that are not normalised (or grow when lower-cased) are
cut into the units that normalisation treats alone, and only a prefix that ends
within such a unit is counted anew, from the tables of its word, so time grows with the
length of the text (and, within one unit, with the square of its combining marks);
repeated rows each get their row; columns other than the id and the text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import importable, slices

#: Entries kept by a worker: word profiles, profiles of space-separated pieces, checked token pairs (some 200 bytes each).
WORDS_KEPT, PIECES_KEPT, PAIRS_KEPT = 600_000, 600_000, 600_000
#: Lengths of word beginnings whose tables are kept, longest first, and how many (some 500 bytes each).
HEADS, HEADS_KEPT = (9, 6, 4), 120_000
#: Longer words and pieces are not kept.
KEPT_CHARS = 48


#: Length of the ends of words whose tokens are kept, and how many ends (some 300 bytes each).
NEAR, NEAR_KEPT = 5, 150_000
#: What a suffix of tokens that is no token itself is.
NO_TOKEN = (-1, -1)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Kept:
    """A bounded dictionary: when the younger half is full it becomes the older one, which is dropped unless used again."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and self.old:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.size // 2:
            self.old, self.young = dict(self.young), self.young
            self.young.clear()
        self.young[key] = value


class PrefixCounter:
    """Token counts of all prefixes under the BPE of a tokenizers file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = frozenset(model["vocab"])
        self.rank = {tuple(p if isinstance(p, list) else p.split(" ")): i for i, p in enumerate(model["merges"])}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.mark = special[0][:2]
        self.symbol = byte_symbols()
        #: every suffix of a token's text: the numbers of the token without and with the word end that it is, or -1
        self.suffix: dict[str, tuple[int, int]] = {}
        self.name = list(model["vocab"])
        for i, t in enumerate(self.name):
            final = t.endswith(self.end) and len(t) > len(self.end)
            t = t[:-len(self.end)] if final else t
            for j in range(len(t)):
                inner, last = self.suffix.get(t[j:], NO_TOKEN)
                if j == 0:
                    inner, last = (inner, i) if final else (i, last)
                self.suffix[t[j:]] = (inner, last) if inner >= 0 or last >= 0 else NO_TOKEN
        self.near: dict[str, tuple[tuple, bool]] = {}
        self.words, self.pieces, self.pairs, self.heads = Kept(WORDS_KEPT), Kept(PIECES_KEPT), Kept(PAIRS_KEPT), Kept(HEADS_KEPT)

    def _symbols(self, token: str) -> list[str]:
        return [*token[:-len(self.end) - 1], token[-len(self.end) - 1:]] if token.endswith(self.end) and len(token) > len(self.end) else [*token]

    def _merged(self, sym: list[str]) -> list[str]:
        """Merges applied one at a time: lowest rank first, then leftmost."""
        rank, never = self.rank.get, 1 << 60
        ranks = [rank(pair, never) for pair in zip(sym, sym[1:])]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            sym[at:at + 2] = [sym[at] + sym[at + 1]]
            # only the pairs beside the merged one change
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((sym[at], sym[at + 1]), never)
            if at:
                ranks[at - 1] = rank((sym[at - 1], sym[at]), never)
        return sym

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (-1: begin a word) in an encoding."""
        key = (a + 1) * len(self.name) + b
        got = self.pairs.get(key)
        if got is None:
            one = [self.name[b]] if a < 0 else [self.name[a], self.name[b]]
            got = self._merged([x for t in one for x in self._symbols(t)]) == one
            self.pairs.put(key, got)
        return got

    def _prefixes(self, s: str) -> list[int]:
        """Counts of s[:1], s[:2], ..., s as words, for a word of byte symbols. Words begin alike, so the table of the
        first few positions is kept and carried on."""
        return self._tables(s)[2]

    def _tables(self, s: str, given: tuple[list[int], list[int]] | None = None) -> tuple[list[int], list[int], list[int]]:
        """The last token and the count of s[:0], s[:1], ..., and the counts of s[:1], ... as words. given: the first two for
        the beginnings of ``s`` that are known (then no beginnings are kept, as ``s`` may be the end of a longer word)."""
        last, count, ended, begin = [-1], [0], [], 0
        if given:
            last, count = given
            begin = len(last) - 1
        for n in HEADS:
            if not given and len(s) > n and (head := self.heads.get(s[:n])) is not None:
                last, count, ended = map(list, head)
                begin = n
                break
        suffix, known, size, kept = self.suffix.get, self.pairs.young.get, len(self.name), () if given else HEADS
        for i in range(begin + 1, len(s) + 1):
            near = s[i - NEAR:i] if i > NEAR else s[:i]
            options, on = self.near.get(near) or self._near(near)
            if on:
                far, j = [], i - NEAR - 1
                while j >= 0 and (t := suffix(s[j:i])) is not None:
                    if t is not NO_TOKEN:
                        far.append((i - j, t))
                    j -= 1
                if far:
                    options = (*far[::-1], *options)
            token = end = -1
            for j, (t, f) in options:
                j = i - j
                before = (last[j] + 1) * size
                if token < 0 and t >= 0:
                    fits = known(before + t)
                    if fits or fits is None and self._fits(last[j], t):
                        token, tokens = t, count[j] + 1
                        if end >= 0:
                            break
                if end < 0 and f >= 0:
                    fits = known(before + f)
                    if fits or fits is None and self._fits(last[j], f):
                        end, ends = f, count[j] + 1
                        if token >= 0:
                            break
            last.append(token)
            count.append(tokens)
            ended.append(ends)
            if i in kept and i < len(s):
                self.heads.put(s[:i], (tuple(last), tuple(count), tuple(ended)))
        return last, count, ended

    def _near(self, s: str) -> tuple[tuple, bool]:
        """The tokens that end s, longest first, with their lengths; and whether longer ones than s may end a word that ends in it."""
        options, n = [], 1
        while n <= len(s) and (t := self.suffix.get(s[len(s) - n:])) is not None:
            if t is not NO_TOKEN:
                options.append((n, t))
            n += 1
        got = tuple(options[::-1]), n > NEAR
        if len(self.near) < NEAR_KEPT:
            self.near[s] = got
        return got

    def _symbols_of(self, w: str) -> tuple[str, list[int]]:
        """The byte symbols of a word, and how many of them each of its beginnings (from the empty one) has."""
        s, at = [], [0]
        for ch in w:
            s += [self.symbol[b] for b in ch.encode("utf-8", "surrogatepass")]
            at.append(len(s))
        return "".join(s), at

    def word(self, w: str) -> bytes | list[int]:
        """Counts of w[:1], w[:2], ..., w, each as a word of its own."""
        got = self.words.get(w)
        if got is not None:
            return got
        if w.isascii() and w.isprintable():
            out = self._prefixes(w)
        else:
            s, at = self._symbols_of(w)
            ended = self._prefixes(s)
            out = [ended[i - 1] for i in at[1:]]
        if len(w) <= KEPT_CHARS:
            out = bytes(out)
            self.words.put(w, out)
        return out

    def _plain(self, low: str) -> list[int]:
        """Counts of low[:0], low[:1], ... of a normalised, lower-cased text."""
        out, base, at = [0], 0, 0
        for m in self.split.finditer(low):
            w = m[0]
            if m.start() > at:
                out += [base] * (m.start() - at)
            at = m.end()
            if w[0] == "'" and len(w) > 1 and w[1].isalpha():  # a contraction: cut, it is an apostrophe and letters
                mark = self.word("'")[0]
                part = [mark, *(mark + c for c in self.word(w[1:])[:-1]), self.word(w)[-1]]
            else:
                part = self.word(w)
            out += [base + c for c in part]
            base += part[-1]
        return out + [base] * (len(low) - at)

    def _ordinary(self, text: str) -> list[int]:
        """The same for a text without special tokens, before normalisation."""
        if text.isascii():
            return self._plain(text.lower())
        low = "".join(map(str.lower, text))
        if len(low) == len(text) and unicodedata.is_normalized("NFC", text):
            return self._plain(low)
        lowered = lambda x: "".join(map(str.lower, unicodedata.normalize("NFC", x)))
        parts = [m[0] for m in _unit().finditer(text)]
        norm = [lowered(p) for p in parts]
        whole = "".join(norm)
        known, out, done = self._plain(whole), [0], 0
        cuts = _Cuts(self, whole, known)
        for part, n in zip(parts, norm):
            # what ends between units, or in one as the whole goes on, is known; what ends within a composed character is not
            for j in range(1, len(part)):
                begun = lowered(part[:j])
                out.append(known[done + len(begun)] if n.startswith(begun) else cuts.count(done, begun))
            done += len(n)
            out.append(known[done])
        return out

    def counts(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], ..., text."""
        if self.mark not in text:
            return self._ordinary(text)
        out, base, at = [0], 0, 0
        for m in self.special.finditer(text):
            out += [base + c for c in self._ordinary(text[at:m.end() - 1])[1:]]
            base += self._ordinary(text[at:m.start()])[-1] + 1
            out.append(base)
            at = m.end()
        return out + [base + c for c in self._ordinary(text[at:])[1:]]

    def _piece(self, piece: str) -> bytes | None:
        """Steps of the counts of a piece and of the space behind it, a signed byte each; None if one does not fit."""
        got = self.pieces.get(piece)
        if got is not None:
            return got
        c = self.counts(piece)
        step = [(y - x) & 255 for x, y in zip(c, c[1:]) if -128 <= y - x < 128]
        if len(step) < len(c) - 1:
            return None
        got = bytes(step) + b"\0"
        if len(piece) <= KEPT_CHARS:
            self.pieces.put(piece, got)
        return got

    def of_text(self, text: str) -> np.ndarray:
        """int32 counts of all prefixes. No token spans white space, so pieces between spaces add up."""
        known, other = self.pieces.young.get, self._piece
        steps = [known(p) or other(p) for p in text.split(" ")]
        out = np.zeros(len(text) + 1, np.int32)
        if None not in steps:
            np.cumsum(np.frombuffer(b"".join(steps), np.int8)[:-1], dtype=np.int32, out=out[1:])
        else:
            at, base = 0, 0
            for p in text.split(" "):
                c = np.asarray(self.counts(p), np.int32)
                out[at:at + len(c)] = base + c
                at, base = at + len(c), base + int(c[-1])
        return out


@functools.cache
def _unit():
    """Matches the stretches that NFC treats alone: a character and all behind it that combine with what is before them."""
    joins = []
    for c in map(chr, range(0x300, 0x110000)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        if unicodedata.combining(c) or not unicodedata.is_normalized("NFC", "\u1100" + c) or not unicodedata.is_normalized("NFC", "\uac00" + c):
            joins.append(c)
    for c in map(chr, range(0x300, 0x110000)):
        pair = unicodedata.decomposition(c).split()
        if len(pair) == 2 and not pair[0].startswith("<"):
            joins.append(chr(int(pair[1], 16)))
    return regex.compile(f"[\\s\\S][{''.join(map(regex.escape, sorted(set(joins))))}]*")


class _Cuts:
    """Counts of beginnings of a normalised text with another ending put on, in time that does not grow with the text."""

    def __init__(self, counter: PrefixCounter, whole: str, known: list[int]):
        self.counter, self.whole, self.known = counter, whole, known
        self.words = [m.span() for m in counter.split.finditer(whole)]
        self.begins = [s for s, _ in self.words]
        self.longest = max(map(len, counter.suffix))
        self.tables: tuple = (-1,)

    def count(self, at: int, ending: str) -> int:
        """The count of whole[:at] + ending."""
        i = bisect.bisect_left(self.begins, at) - 1
        start, stop = self.words[i] if i >= 0 else (at, at)
        if stop < at:
            start = at
        before = self.known[start]
        if at - start <= KEPT_CHARS:
            return before + self.counter._plain(self.whole[start:at] + ending)[-1]
        # a long word: it goes on if the ending, put behind its last character, is still one match
        if self.counter.split.fullmatch(self.whole[at - 1] + ending) is None:
            return self.known[at] + self.counter._plain(ending)[-1]
        if self.tables[0] != start:
            symbols, ends = self.counter._symbols_of(self.whole[start:stop])
            self.tables = (start, symbols, ends, *self.counter._tables(symbols)[:2])
        _, symbols, ends, last, count = self.tables
        n = ends[at - start]
        low = max(0, n - self.longest)
        more, _ = self.counter._symbols_of(ending)
        return before + self.counter._tables(symbols[low:n] + more, (last[low:n + 1], count[low:n + 1]))[2][-1]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, tokenizer: str, budgets: tuple[int, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, counts, fits.

    ``counts[i]`` is the number of tokens of the first i characters (code points), from 0 to the length.
    ``fits[j]`` is the largest i with ``counts[i] <= budgets[j]``: where to cut a text for a budget.
    ``tokenizer`` is the path of the file, the same on every worker."""
    def run(batches):
        c = counter(tokenizer)
        for b in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            got = [c.of_text(t) for t in texts]
            size = np.asarray([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            off = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            fits = [[int(np.flatnonzero(x <= n)[-1]) for n in budgets] for x in got]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(size), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(got))),
                pa.array(fits, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "counts", "fits"])

    importable(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, counts array<int>, fits array<int>")


def tokens_at(counts: str, chars: int | Column) -> Column:
    """Tokens of the first ``chars`` characters, without encoding again; null beyond the end of the text."""
    return F.try_element_at(counts, (F.lit(chars) if isinstance(chars, int) else chars) + 1)
