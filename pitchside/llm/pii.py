"""Operator 11: personal data by rules and a semi-Markov conditional random field.

Rules find the base spans of four kinds (``base_spans``); they always stay. Around
every number or at-sign that might be personal data in another spelling ("ann (at) mail
dot com", "1[.]2[.]3[.]4", "4417.7442.8035.1547", "001 (017) 555-7713") a zone of tokens
is cut. In a zone every run of at most ``SPAN`` tokens is a candidate segment; features of
the whole segment (digits and their groups, check digit, separators, values of the
groups, outline, both edges, words beside it) score it for each kind, transitions score
neighbouring segments, and a dynamic program over all segmentations with entities of at
most ``SPAN`` tokens chooses boundaries and kinds jointly. Tokens of base spans are held
fixed, so added spans never overlap base ones. Outside the zones there are no candidates,
so decoding zone by zone is exact for the whole text.

The model is learned from the corpus without labels: a bounded sample of base spans with
the text beside them (``SAMPLE`` of each kind, those with the smallest hashes), as found and
respelled with other digits, and as decoys that break the kind's rule; and as many zones
without a base span, which count as no personal data. It is fitted by exact gradients of
the likelihood (forward-backward over segments) in numpy on the driver. Without base spans
in the corpus nothing is learned and only base spans are found.

Nothing is shuffled but the sample; every text is scanned twice, in linear time.

Edge cases: null text is empty and has no spans; rows are judged one by one, so repeated
rows and null ids stay as they are; texts of any length are scanned whole (a text is a row,
and its zones are decoded in pieces); positions are code points; equal scores go to the
shorter segment and the kind listed first; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import importable, slices, written

KINDS = ("email", "ip", "card", "phone")
#: Spans sampled of each kind (and zones without one), characters of text beside them, tokens of the longest entity,
#: weights of a kind (hashed features), passes over the sample, step.
SAMPLE, BESIDE, SPAN, WEIGHTS, PASSES, STEP = 250, 40, 28, 1 << 15, 6, 0.3
#: Score that every added segment must overcome: one more wrong span costs more than one missed.
DOUBT = 2.0

# Patterns of the base kinds (possessive forms of the stated ones, so that long runs take linear time).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Spellings of at-signs and dots that zones are cut around.
_AT = ("@", "＠", " at ", "[at]", "(at)", "{at}", "[AT]", "(AT)", " AT ", "[@]", "(@)", " arroba ", "(arroba)")
_DOT = r"(?:\.| ?[\[({](?:\.|dot|punkt|point|punto)[\])}] ?| (?:\.|dot|punkt|point|punto) )"
_HOST = re.compile(rf" {{0,2}}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+")
_NUMBER = re.compile(rf"[0-9]++(?:(?:[ ().,/_:·+‐-―\[\]-]{{1,4}}|{_DOT})[0-9]++)*+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed: leftmost matches of each kind that do not overlap, without those
    that fail the kind's rule."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Stretches:
    """Spans of a text merged where they overlap, for lookups."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in spans:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meet(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def cover(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] <= a and self.ends[i] >= b


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold personal data in any spelling, merged where they touch."""
    found = []
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        if e - s >= 7:
            groups = _NOT_DIGIT.split(m.group())
            if len(groups) >= 4 or sum(map(len, groups)) >= 7:
                while s > 0 and text[s - 1] in "+(" and m.start() - s < 3:
                    s -= 1
                found.append((s, e))
    for sign in _AT:
        at = text.find(sign)
        while at >= 0:
            end = start = at
            while start > 0 and text[start - 1] == " " and at - start < 2:
                start -= 1
            end = start
            while start > 0 and end - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            m = _HOST.match(text, at + len(sign)) if start < end else None
            if m:
                found.append((start, m.end()))
            at = text.find(sign, at + 1)
    found.sort()
    out: list[list[int]] = []
    for s, e in found:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Classes of tokens: blank, digits, letters, at-sign or its word, dot or its word, then one for each kind of separator.
_SIGNS = {"@": 3, "＠": 3, ".": 4, "-": 5, "‐": 5, "–": 5, "—": 5, "(": 6, "[": 6, "{": 6, ")": 7, "]": 7, "}": 7, "+": 8, "/": 9, "_": 9, "·": 9,
          ",": 10, ":": 10, "%": 11}
_WORDS = {"at": 3, "arroba": 3, "dot": 4, "punkt": 4, "point": 4, "punto": 4}
_CLASSES = 13


class Tokens:
    """Tokens of many zones one after another, with prefix sums from which features of any run of tokens follow."""

    def __init__(self, texts: list[str], spans: list[tuple[int, int, int]], fixed: dict[int, "Stretches"]):
        """spans: (number of the text, start, end) of each zone; fixed: base spans of the texts that have some."""
        start, end, cls, size, zone, words, digits, over, held, before, after = ([] for _ in range(11))
        none = Stretches([])
        for z, (t, s, e) in enumerate(spans):
            text, base = texts[t], fixed.get(t, none)
            left, right = _side(text[max(0, s - BESIDE):s][::-1], -1), _side(text[e:e + BESIDE], 1)
            before.append(left)
            after.append(right)
            for m in _TOKEN.finditer(text, s, e):
                word, a, b = m.group(), m.start(), m.end()
                start.append(a)
                end.append(b)
                zone.append(z)
                held.append(base.meet(a, b))
                c = word[0]
                if c.isspace():
                    k = 0
                elif "0" <= c <= "9":
                    k = 1
                    digits.append(word)
                elif c.isascii() and c.isalpha():
                    k = _WORDS.get(word.lower(), 2)
                else:
                    k = _SIGNS.get(c, 12)
                cls.append(k)
                size.append(b - a)
                over.append(k == 1 and (len(word.lstrip("0")) > 3 or int(word.lstrip("0") or 0) > 255))
                words.append(_word(word) if k in (2, 3, 4) else k)
        self.start, self.end, self.cls, self.size, self.zone = (np.array(x, np.int64) for x in (start, end, cls, size, zone))
        self.words = np.array(words, np.int64)
        n = len(start)
        self.first = np.searchsorted(self.zone, np.arange(len(spans) + 1)) if n else np.zeros(len(spans) + 1, np.int64)
        self.before, self.after = np.array(before, np.int64).reshape(-1, 2), np.array(after, np.int64).reshape(-1, 2)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        is_digit = self.cls == 1
        self.n_digits = total(np.where(is_digit, self.size, 0))
        self.of_class = np.stack([total(self.cls == k) for k in range(_CLASSES)])
        self.over, self.held = total(np.array(over, bool)), total(np.array(held, bool))
        # check digit sums with the digits at even, and at odd, places counted twice
        d = np.frombuffer("".join(digits).encode(), np.uint8).astype(np.int64) - 48
        twice = 2 * d - 9 * (d > 4)
        even = np.arange(len(d)) % 2 == 0
        self.sum = [total(np.where(even, d, twice)), total(np.where(even, twice, d))]
        # outline of a run: a polynomial hash over classes, digits with the length of their group
        shape = np.where(is_digit, 20 + np.minimum(self.size, 20), self.cls).astype(np.uint64) + np.uint64(1)
        power, self.inverse = (np.cumprod(np.concatenate([[1], np.full(n, base, np.uint64)]).astype(np.uint64)) for base in (_BASE, _INVERSE))
        self.outline = np.zeros(n + 1, np.uint64)
        np.cumsum(shape * power[:n], out=self.outline[1:])

    def candidates(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first token, token after the last) of the candidate segments that end with one of the tokens ``last``: runs of at most SPAN tokens
        within a zone, without blanks at the edges and tokens of base spans, with at least four digits or an at-sign."""
        s = last[:, None] - np.arange(SPAN)
        ok = s >= self.first[self.zone[last]][:, None]
        i, j = np.nonzero(ok)
        s, e = s[i, j], last[i] + 1
        ok = (self.cls[s] != 0) & (self.cls[e - 1] != 0) & (self.held[e] == self.held[s])
        ok &= (self.n_digits[e] - self.n_digits[s] >= 4) | (self.of_class[3, e] > self.of_class[3, s])
        return s[ok], e[ok]

    def features(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hashed features of the segments [s, e), one row each."""
        z = self.zone[s]
        at_start, at_end = s == self.first[z], e == self.first[z + 1]
        nd = self.n_digits[e] - self.n_digits[s]
        of = self.of_class[:, e] - self.of_class[:, s]
        groups = of[1]
        signs = sum((np.minimum(of[k], 1) << k for k in range(2, _CLASSES)), np.zeros(len(s), np.int64))
        last_place = self.n_digits[e] - 1
        check = np.where(last_place % 2 == 0, self.sum[0][self.n_digits[e]] - self.sum[0][self.n_digits[s]], self.sum[1][self.n_digits[e]] - self.sum[1][self.n_digits[s]])
        card = (nd >= 14) & (nd <= 19) & (check % 10 == 0)
        small = self.over[e] == self.over[s]
        outline = (self.outline[e] - self.outline[s]) * self.inverse[s]
        prev = np.where(at_start, self.before[z, 0], self.cls[np.maximum(s - 1, 0)])
        after = np.where(at_end, self.after[z, 0], self.cls[np.minimum(e, len(self.cls) - 1)])
        left = np.where(at_start, self.before[z, 1], self.words[np.maximum(s - 1, 0)])
        right = np.where(at_end, self.after[z, 1], self.words[np.minimum(e, len(self.cls) - 1)])
        first, last = self.cls[s], self.cls[e - 1]
        nd, groups, dots, ats = np.minimum(nd, 21), np.minimum(groups, 9), np.minimum(of[4], 4), np.minimum(of[3], 2)
        even = of[6] == of[7]
        edge = np.minimum(self.size[s], 6) * 8 + np.minimum(self.size[e - 1], 6)
        cols = [nd * 10 + groups, signs, outline.astype(np.int64), card * 32 + nd, (small & (groups == 4)) * 16 + groups, ats * 8 + dots, prev * 16 + first, after * 16 + last,
                left, right, even * 256 + first * 16 + last, (edge * 16 + first) * 16 + last, signs * 32 + nd, np.zeros(len(s), np.int64),
                (small & (groups == 4)) * 256 + (ats > 0) * 128 + card * 64 + (nd >= 10) * 32 + (nd <= 15) * 16 + even * 8 + dots, prev * 16 + after]
        out = np.empty((len(s), len(cols)), np.int64)
        for k, c in enumerate(cols):
            h = (c.astype(np.uint64) + np.uint64((k + 1) * int(_BASE) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            out[:, k] = (h * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % WEIGHTS
        return out


def _word(w: str) -> int:
    return 1000 + int.from_bytes(hashlib.blake2b(w.lower().encode("utf-8", "replace"), digest_size=5).digest(), "big")


def _side(text: str, step: int) -> tuple[int, int]:
    """(class of the nearest character, hash of the nearest word) beside a zone; ``text`` leads away from it."""
    if not text:
        return 15, 0
    m = re.search(r"[^\W\d_]+", text)
    c = text[0]
    kind = 0 if c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else _SIGNS.get(c, 12)
    return kind, _word(m.group()[::step]) if m else 1


class Model:
    """Weights (kind, feature) and transitions (previous, next) over the kinds and, as the last one, no kind."""

    def __init__(self):
        n = len(KINDS)
        self.w = np.zeros((n, WEIGHTS))
        self.trans = np.zeros((n + 1, n + 1))

    def segment_scores(self, tokens: Tokens, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.empty((len(s), len(KINDS)))
        for a in range(0, len(s), 20_000):
            f = tokens.features(s[a:a + 20_000], e[a:a + 20_000])
            out[a:a + 20_000] = self.w[:, f].sum(axis=2).T
        return out


def _blocks(tokens: Tokens, most: int):
    """Zones in blocks of like lengths: (zones, longest length); a block has at most ``most`` places, or one zone."""
    length = np.diff(tokens.first)
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and length[order[stop]] * (stop + 1 - at) <= most:
            stop += 1
        yield order[at:stop], int(length[order[stop - 1]])
        at = stop


def decode(model: Model, tokens: Tokens, doubt: float = DOUBT, piece: int = 2_048) -> list[tuple[int, int, int]]:
    """(first token, token after the last, kind) of the entities of the best segmentation of every zone."""
    n = len(KINDS)
    out = []
    length = np.diff(tokens.first)
    for zone, longest in _blocks(tokens, piece):
        rows = len(zone)
        first, size = tokens.first[zone], length[zone]
        at_row = np.zeros(len(length), np.int64)
        at_row[zone] = np.arange(rows)
        # entering[t]: best score before a segment of each kind that begins at place t, and the kind that ends there
        entering = np.full((rows, longest + 1, n + 1), -np.inf)
        came = np.zeros((rows, longest + 1, n + 1), np.int8)
        seg = np.ones((rows, longest + 1, n + 1), np.int8)
        final = np.zeros(rows, np.int64)
        entering[:, 0], came[:, 0] = model.trans[n], n
        for a in range(0, longest, piece):
            b = min(a + piece, longest)
            phi = np.full((rows, b - a, SPAN, n), -np.inf, np.float32)
            within = np.clip(size - a, 0, b - a)
            row = np.repeat(np.arange(rows), within)
            s, e = tokens.candidates(np.arange(within.sum()) - np.repeat(np.cumsum(within) - within, within) + first[row] + a)
            row = at_row[tokens.zone[s]]
            phi[row, e - first[row] - 1 - a, e - s - 1] = model.segment_scores(tokens, s, e) - doubt
            any_at = np.isfinite(phi).any(axis=(0, 2, 3))
            for t in range(a + 1, b + 1):
                ends = np.full((rows, n + 1), -np.inf)
                ends[:, n] = entering[:, t - 1, n]
                if any_at[t - 1 - a]:
                    w = min(SPAN, t)
                    score = entering[:, t - w:t, :n][:, ::-1] + phi[:, t - 1 - a, :w]
                    pick = score.argmax(axis=1)
                    ends[:, :n] = np.take_along_axis(score, pick[:, None], axis=1)[:, 0]
                    seg[:, t, :n] = pick + 1
                step = ends[:, :, None] + model.trans
                came[:, t] = step.argmax(axis=1)
                entering[:, t] = step.max(axis=1)
                stop = size == t
                final[stop] = came[stop, t, n]
        for r in range(rows):
            t, y = int(size[r]), int(final[r])
            while t > 0:
                m = int(seg[r, t, y]) if y < n else 1
                if y < n:
                    out.append((int(first[r]) + t - m, int(first[r]) + t, y))
                t -= m
                y = int(came[r, t, y])
    return sorted(out)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis))


def marginals(trans: np.ndarray, phi: np.ndarray, size: np.ndarray):
    """Forward-backward over all segmentations of zones of ``size`` tokens. phi[row, end - 1, length - 1, kind]: scores of the segments.

    Returns the log partition sums, the probability of every segment like phi, and the expected transitions."""
    rows, longest, _, n = phi.shape
    forward = np.full((rows, longest + 1, n + 1), -np.inf)  # segmentations that end at t with a segment of the kind
    entering = np.full((rows, longest + 1, n + 1), -np.inf)
    forward[:, 0, n] = 0
    entering[:, 0] = trans[n]
    for t in range(1, longest + 1):
        w = min(SPAN, t)
        forward[:, t, :n] = _log_sum(entering[:, t - w:t, :n][:, ::-1] + phi[:, t - 1, :w], 1)
        forward[:, t, n] = entering[:, t - 1, n]
        entering[:, t] = _log_sum(forward[:, t, :, None] + trans, 1)
    at = np.arange(rows)
    z = entering[at, size, n]
    leaving = np.full((rows, longest + 1, n + 1), -np.inf)  # what can follow a segment of the kind that ends at t
    following = np.full((rows, longest + 1, n + 1), -np.inf)  # what can begin at t with a segment of the kind
    for t in range(longest, -1, -1):
        if t < longest:
            w = min(SPAN, longest - t)
            ends = np.arange(t + 1, t + 1 + w)
            following[:, t, :n] = _log_sum(phi[:, ends - 1, np.arange(w)] + leaving[:, ends, :n], 1)
            following[:, t, n] = leaving[:, t + 1, n]
        leaving[:, t] = _log_sum(trans + following[:, t, None, :], 2)
        leaving[size == t] = np.where(np.arange(longest + 1)[None, :, None] == t, trans[:, n], leaving[size == t])
        following[size == t, t:] = -np.inf
    p = np.zeros_like(phi)
    for t in range(1, longest + 1):
        w = min(SPAN, t)
        p[:, t - 1, :w] = np.exp(entering[:, t - w:t, :n][:, ::-1] + phi[:, t - 1, :w] + leaving[:, t, None, :n] - z[:, None, None])
    inside = (np.arange(longest + 1) < size[:, None])[:, :, None, None]
    crossed = np.exp(forward[:, :, :, None] + trans + following[:, :, None, :] - z[:, None, None, None]) * inside
    over = crossed.sum(axis=(0, 1))
    over[:, n] += np.exp(forward[at, size] + trans[:, n] - z[:, None]).sum(axis=0)
    return z, p, over


def _paths(tokens: Tokens, gold: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Transitions of the given segmentations (token spans with kinds, by zone), counted."""
    n = len(KINDS)
    out = np.zeros((len(gold), n + 1, n + 1))
    for z, spans in enumerate(gold):
        t, y = int(tokens.first[z]), n
        for s, e, k in [*spans, (int(tokens.first[z + 1]), None, n)]:
            if s > t:
                out[z, y, n] += 1
                out[z, n, n] += s - t - 1
                y = n
            out[z, y, k] += 1
            t, y = e, k
    return out


def fit(texts: list[str], marks: list[list[tuple[str, int, int]]], passes: int = PASSES) -> Model:
    """Maximum likelihood of the marked spans of the texts; zones whose marks are no candidate segments are left out."""
    model = Model()
    spans, want = [], []
    for t, text in enumerate(texts):
        for s, e in zones(text):
            spans.append((t, s, e))
            want.append([m for m in marks[t] if m[1] >= s and m[2] <= e])
    tokens = Tokens(texts, spans, {})
    n, length = len(KINDS), np.diff(tokens.first)
    begins = [{int(a): int(i) for i, a in zip(range(tokens.first[z], tokens.first[z + 1]), tokens.start[tokens.first[z]:tokens.first[z + 1]])} for z in range(len(spans))]
    stops = [{int(a): int(i) + 1 for i, a in zip(range(tokens.first[z], tokens.first[z + 1]), tokens.end[tokens.first[z]:tokens.first[z + 1]])} for z in range(len(spans))]
    gold, good = [], []
    for z, m in enumerate(want):
        cut = sorted((begins[z].get(s), stops[z].get(e), KINDS.index(k)) for k, s, e in m if s in begins[z] and e in stops[z])
        gold.append(cut)
        apart = all(x[1] <= y[0] for x, y in zip(cut, cut[1:]))
        good.append(len(cut) == len(m) and apart and all(e - s <= SPAN for s, e, _ in cut) and 0 < length[z] <= 4 * SPAN)
    s, e = tokens.candidates(np.arange(len(tokens.start)))
    features = np.concatenate([tokens.features(s[i:i + 20_000], e[i:i + 20_000]) for i in range(0, len(s), 20_000)]).astype(np.int32) if len(s) else np.zeros((0, 1), np.int32)
    zone = tokens.zone[s]
    order = np.argsort(zone, kind="stable")
    s, e, features, zone = s[order], e[order], features[order], zone[order]
    bound = np.searchsorted(zone, np.arange(len(spans) + 1))
    walked = _paths(tokens, gold)
    use = np.array([z for z in range(len(spans)) if good[z]], np.int64)
    use = use[np.argsort(length[use], kind="stable")] if len(use) else use
    batches = [use[i:i + 64] for i in range(0, len(use), 64)]
    seen_w, seen_t = np.full_like(model.w, 1e-2), np.full_like(model.trans, 1e-2)
    rng = np.random.default_rng(11)
    for _ in range(passes):
        for b in rng.permutation(len(batches)):
            zs = batches[b]
            pick = np.concatenate([np.arange(bound[z], bound[z + 1]) for z in zs])
            row = np.repeat(np.arange(len(zs)), bound[zs + 1] - bound[zs])
            f, first = features[pick], tokens.first[zs][row]
            place = (row, e[pick] - first - 1, e[pick] - s[pick] - 1)
            phi = np.full((len(zs), int(length[zs].max()), SPAN, n), -np.inf)
            phi[place] = model.w[:, f].sum(axis=2).T
            _, p, over = marginals(model.trans, phi, length[zs])
            diff = -p[place]
            at = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(s[pick], e[pick]))}
            for z in zs:
                for x, y, k in gold[z]:
                    if (x, y) in at:
                        diff[at[x, y], k] += 1
            step = np.stack([np.bincount(f.ravel(), np.repeat(diff[:, k], f.shape[1]), WEIGHTS) for k in range(n)])
            seen_w += step * step
            model.w += STEP * step / np.sqrt(seen_w)
            step = walked[zs].sum(axis=0) - over
            seen_t += step * step
            model.trans += STEP * step / np.sqrt(seen_t)
    return model


def _respelled(kind: str, span: str, r: random.Random) -> str:
    """The span with other digits and spelling, still of its kind."""
    digit = lambda m: r.choice("0123456789")
    if kind == "email":
        local, _, host = span.partition("@")
        if r.randrange(2):
            # other addresses: without digits, with fewer parts
            local = re.sub(r"[0-9._%+-]+", lambda m: r.choice(["", m.group(), "_", "."]), local).strip("._%+-") or local
            host = re.sub("[0-9]+", "", host) if r.randrange(2) else host
            labels = [x for x in host.split(".") if x]
            host = ".".join(labels[-max(2, r.randrange(4)):]) if len(labels) > 1 else host
        dot = r.choice([".", " dot ", "[dot]", "(dot)", " [dot] ", " (dot) ", "[.]", " . "])
        sign = r.choice([" at ", "[at]", "(at)", " [at] ", " (at) ", " @ ", "＠", "(@)", " arroba "] + ["@"] * (dot != "."))
        return re.sub("[0-9]", digit, local) + sign + re.sub("[0-9]", digit, host).replace(".", dot)
    if kind == "ip":
        return r.choice(["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)"]).join(str(r.randrange(256)) for _ in range(4))
    if kind == "card":
        digits = _card(r, len(_NOT_DIGIT.sub("", span)))
        return r.choice([".", "/", "_", "  ", " - ", ". "]).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    digits = re.sub("[0-9]", digit, span[1:])
    style = r.randrange(4)
    if style < 2:
        return ("", "00")[style] + digits
    return ("+", "00")[style - 2] + r.choice("/_,·").join(x for x in _NOT_DIGIT.split(digits) if x)


def _card(r: random.Random, n: int) -> str:
    body = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _decoy(kind: str, span: str, r: random.Random) -> str:
    """Something that looks like the span but breaks its kind's rule."""
    if kind == "email":
        return re.sub("[0-9]", lambda m: r.choice("0123456789"), span.partition("@")[0]) + r.choice([" at ", "@", " @ "]) + span.partition("@")[2].partition(".")[0]
    if kind == "ip":
        return r.choice([".", "[.]", " . ", " dot "]).join(str(x) for x in r.sample([r.randrange(256, 1000), r.randrange(256), r.randrange(256), r.randrange(256)], 4))
    if kind == "card":
        digits = _card(r, len(_NOT_DIGIT.sub("", span)))
        i = r.randrange(len(digits))
        digits = digits[:i] + str((int(digits[i]) + r.randrange(1, 10)) % 10) + digits[i + 1:]
        return r.choice(["", "", ".", "/", "  ", " - "]).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    digits = re.sub("[0-9]", lambda m: r.choice("0123456789"), _NOT_DIGIT.sub("", span))[:r.randrange(6, 9)]
    return r.choice(["", "+"]) + digits[:3] + r.choice([" ", "-", "/"]) + digits[3:]


def _sampled(sample: int):
    def run(batches):
        held: dict = {k: {} for k in (*KINDS, "none")}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                known = Stretches(base)
                clear = [("none", s, e) for s, e in zones(text) if e - s <= 4 * BESIDE and not known.meet(s, e)]
                for kind, s, e in [x for x in base if x[2] - x[1] <= 2 * BESIDE] + clear:
                    left, span, right = text[max(0, s - BESIDE):s], text[s:e], text[e:e + BESIDE]
                    key = int.from_bytes(hashlib.blake2b("\0".join((left, span, right)).encode("utf-8", "replace"), digest_size=7).digest(), "big")
                    held[kind][key] = (left, span, right)
                    if len(held[kind]) >= 4 * sample:
                        held[kind] = {k: held[kind][k] for k in heapq.nsmallest(sample, held[kind])}
        rows = [(kind, k, *found[k]) for kind, found in held.items() for k in heapq.nsmallest(sample, found)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 1 else pa.string()) for i in range(5)], names=["kind", "h", "left", "span", "right"])
    return run


def _texts(docs: DataFrame, keep: str = "") -> DataFrame:
    return docs.selectExpr(*([f"`{keep}`"] if keep else []), "CAST(text AS STRING) AS text")


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the corpus; None if it has no base span. ``sample`` bounds what the driver gathers: so many spans of a kind, with
    the text beside them."""
    importable(docs.sparkSession)
    rows = written(_texts(docs).where("text IS NOT NULL").mapInArrow(_sampled(sample), "kind string, h long, left string, span string, right string").distinct(), "pii-sample")
    texts, marks = [], []

    def add(left: str, span: str, right: str, kind: str | None = None) -> None:
        """A text whose span is of the kind, or of none; what the rules find beside it stays marked."""
        stop = len(left) + len(span)
        texts.append(left + span + right)
        marks.append([x for x in base_spans(left) if x[2] < len(left)] + ([(kind, len(left), stop)] if kind else [])
                     + [(k, s + stop, e + stop) for k, s, e in base_spans(right) if s > 0])

    some = False
    for kind in (*KINDS, "none"):
        for r in rows.where(F.col("kind") == kind).orderBy("h", "left", "span", "right").limit(sample).collect():
            texts.append(r.left + r.span + r.right)
            marks.append(base_spans(texts[-1]))
            if kind != "none":
                some = True
                rng = random.Random(r.h)
                for _ in range(3):
                    add(r.left, _respelled(kind, r.span, rng), r.right, kind)
                add(r.left, _decoy(kind, r.span, rng), r.right)
    return fit(texts, marks) if some else None


def found_spans(model: Model | None, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """All spans (kind, start, end, by the rules) of each text, by start, then kind as listed."""
    out = []
    cut, fixed = [], {}
    for t, text in enumerate(texts):
        base = base_spans(text)
        out.append([(*s, True) for s in base])
        if model is not None:
            fixed[t] = Stretches(base)
            cut += [(t, s, e) for s, e in zones(text) if not fixed[t].cover(s, e)]
    if cut:
        tokens = Tokens(texts, cut, fixed)
        for a, b, k in decode(model, tokens):
            out[cut[tokens.zone[a]][0]].append((KINDS[k], int(tokens.start[a]), int(tokens.end[b - 1]), False))
    return [sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))) for spans in out]


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with [KIND] for each span; of overlapping spans the first names the whole."""
    parts, done = [], 0
    stop = -1
    for kind, s, e, _ in spans:
        if s >= stop:
            parts += [text[done:s], f"[{kind.upper()}]"]
        stop = done = max(stop, e)
    return "".join(parts) + text[done:]


def _marked(model: Model | None):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("span", pa.string())])

    def run(batches):
        for b in slices(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            spans = found_spans(model, texts)
            rows = [[{"kind": k, "start": s, "end": e, "base": base, "span": x[s:e]} for k, s, e, base in found] for x, found in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind)), pa.array([redact(x, f) for x, f in zip(texts, spans)], pa.string())], names=["doc_id", "spans", "redacted"])
    return run


def personal_data(docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base, span>>, redacted) of every row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)
    model = model or learn(docs, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs, "doc_id").mapInArrow(_marked(model), f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean, span: string>>, redacted string")
