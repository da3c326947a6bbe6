"""Operator 5: benchmark decontamination by template canonicalisation.

Texts become canonical tokens: punctuation and quotes dropped, words parted at white
space of every kind, hyphens and dashes, letters of up to two bytes and
U+1E00 to U+1FFF lower-cased, and runs of numbers, names and units replaced by one
typed placeholder each. Capitals tell the names, so a text has three forms: one with
names inside sentences, one with those that begin sentences as well (and with other
words there), and one of literal words for what is all in upper, title or lower case.
Windows of tokens (templates) of documents and benchmark items are joined by hash,
form by form. For each document, item and form the distinct item windows met on
neighbouring diagonals (position in the document less position in the item; a word
put in or left out moves it) are counted, and the slots behind the placeholders must
correspond: every value of the item to one value of the document throughout,
else the windows that hold it do not count. Items of up to 54 tokens have smaller
windows as well, as a few edits hit most of the long ones.
So a question with other numbers or names is caught, one that merely has the same
frame is not.

Document windows first meet a bitmap of fixed size made from the item windows,
so only possible hits are shuffled, however large the benchmark is.

Edge cases: null, empty or wordless texts have no windows and never match; items
shorter than the window match whole, windows with fewer than ``LITERALS`` plain
tokens only with equal slot values; every row is judged by its own text, so rows
of one id (or without one) that have different texts do not answer for each other,
and repeated rows of one id and text count once; texts are one row each, cut into
blocks of rows only, so a text of any length is judged whole; extra columns of any
name are ignored or kept; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchside.llm.common import U64, Words, flat_bytes, importable, mix, slices, unused, written

#: Diagonals that are taken together (in two offset rows of bands, so drifts of up to half of it always are).
BAND = 16
#: Tokens of a window, least plain tokens of a template, log2 of the bits of the bitmap.
WINDOW, LITERALS, BITMAP_BITS = 8, 3, 24
#: Texts that a task remembers, so that it passes copies on once (more only cost time).
MET = 200_000
#: Most texts to drop (some 50 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words that are units of measure, and words that are numbers.
UNITS = """kg g mg lb lbs oz km m cm mm mi mile miles foot feet inch inches yard yards meter meters metre metres
kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre
litres ml l gallon gallons second seconds minute minutes hour hours day days week weeks month months year years
percent dollar dollars euro euros cent cents usd eur gbp degree degrees mph kmh kwh watt watts volt volts""".split()
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
half third quarter twice double triple first second dozen""".split()
#: Words that stay in lower case in titles.
SMALL = """a an the and but or nor of in on at to by for from with as is de la le les el los las en y et du des un une
una al o e""".split()
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Forms of a text: capitals inside sentences are names; no names; all capitals are names.
FORMS = INSIDE, LITERAL, INITIAL = 0, 1, 2
_KINDS = ("", "number", "name", "unit")


def _hashes(words: list[str]) -> np.ndarray:
    raw, off = flat_bytes(pa.array(words, pa.string()))
    return np.sort(Words(raw, off).hash)


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def _fold_table(points: range, lead: int) -> np.ndarray:
    """Lower case of letters by the last two bytes of their UTF-8 form, where that has the same length (and ``lead``)."""
    table = np.arange(1 << 16, dtype=np.uint16)
    for c in map(chr, points):
        one, two = c.encode(), c.lower().encode()
        if len(one) == len(two) == 2 + (lead > 0) and (not lead or one[0] == two[0] == lead):
            table[one[-2] << 8 | one[-1]] = two[-2] << 8 | two[-1]
    return table


#: Letters of two bytes (Latin, Greek, Cyrillic), and those of U+1E00 to U+1FFF.
_FOLD2, _FOLD3 = _fold_table(range(0x80, 0x800), 0), _fold_table(range(0x1E00, 0x2000), 0xE1)


def _folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, and for each byte whether a capital letter begins there."""
    capital, out = (raw >= 65) & (raw <= 90), raw.copy()
    for lead, table, skip in (((raw >= 0xC3) & (raw <= 0xDF), _FOLD2, 0), (raw == 0xE1, _FOLD3, 1)):
        at = np.flatnonzero(lead)
        at = at[at + skip + 1 < len(raw)]
        old = raw[at + skip].astype(np.uint16) << 8 | raw[at + skip + 1]
        new = table[old]
        at, new = at[new != old], new[new != old]
        capital[at] = True
        out[at + skip], out[at + skip + 1] = new >> 8, new & 255
    out[(raw >= 65) & (raw <= 90)] += 32
    return out, capital


def _plain_breaks(raw: np.ndarray) -> np.ndarray:
    """The bytes with blanks for hyphens, dashes and white space beyond ASCII, and zeros (which are dropped) for quotes beyond ASCII."""
    out = np.where(raw == 45, np.uint8(32), raw)
    at = np.flatnonzero(raw == 0xC2)
    at = at[at + 1 < len(raw)]
    second = raw[at + 1]
    for hit, as_byte in ((at[second == 0xA0], 32), (at[(second == 0xAB) | (second == 0xBB)], 0)):
        out[hit], out[hit + 1] = as_byte, 0
    at = np.flatnonzero((raw == 0xE2) | (raw == 0xE3) | (raw == 0xE1))
    at = at[at + 2 < len(raw)]
    code = raw[at].astype(np.int64) << 16 | raw[at + 1].astype(np.int64) << 8 | raw[at + 2]
    general = (code >= 0xE28080) & (code <= 0xE280AF)
    last = code & 255
    quote = general & (last >= 0x98) & (last <= 0x9F) | (code == 0xE280B9) | (code == 0xE280BA)
    blank = general & ((last <= 0x8B) | (last >= 0x90) & (last <= 0x95) | (last >= 0xA8) & (last <= 0xA9) | (last == 0xAF)) | (code == 0xE2819F) | (code == 0xE38080) | (code == 0xE19A80) | (code == 0xE28892)
    for hit, as_byte in ((at[blank], 32), (at[quote], 0)):
        out[hit], out[hit + 1], out[hit + 2] = as_byte, 0, 0
    return out


class Marked:
    """Words of a block of texts, marked: kind (but for names), capital, begin of a sentence, lower case, text of each."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, units: np.ndarray, numbers: np.ndarray, small: np.ndarray):
        raw = _plain_breaks(raw)
        solid = ((raw >= 48) & (raw <= 57)) | ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        kept = np.flatnonzero(solid | space)
        low, upper = _folded(raw)
        self.words = w = Words(low[kept], np.searchsorted(kept, off), lower=False)
        n = len(w.start)
        digit = np.concatenate([[0], np.cumsum((w.bytes >= 48) & (w.bytes <= 57))])
        self.kind = kind = np.zeros(n, np.int8)
        at = kept[w.start] if n else kept[:0]
        self.capital = upper[at]
        stop = np.concatenate([[0], np.cumsum((raw == 46) | (raw == 33) | (raw == 63) | (raw == 58) | (raw == 10))])
        self.doc = doc = np.repeat(np.arange(len(off) - 1), np.diff(w.first))
        before = np.empty(n, np.int64)  # end of the word before, or the begin of the text
        if n:
            ends = kept[w.end - 1] + 1
            before[0], before[1:] = off[doc[0]], ends[:-1]
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            before[head] = -1
        self.begins = (before < 0) | (stop[at] > stop[np.maximum(before, 0)])
        kind[_among(w.hash, units)] = UNIT
        kind[_among(w.hash, numbers) | (digit[w.end] > digit[w.start])] = NUMBER
        # words that show that capitals mean something
        self.lower = ~self.capital & (digit[w.end] == digit[w.start]) & ~_among(w.hash, small)


def _sizes(n: int) -> set[int]:
    """Windows of an item of n tokens: WINDOW or the whole item, and a smaller one of which a few edits leave half."""
    return {min(n, WINDOW)} | ({3 if n < 11 else 4 if n < 34 else 5} if WINDOW <= n < 55 else set())


class Tokens:
    """Canonical tokens of one form of texts: kind, hash, hash of the value, span in the kept bytes, first token of each text."""

    def __init__(self, m: Marked, form: int):
        w, doc, self.form = m.words, m.doc, form
        self.bytes, n = w.bytes, len(w.start)
        name = m.capital & ~m.begins
        named = (name, np.zeros(n, bool), m.capital)[form]
        kind = np.where((m.kind == PLAIN) & named, NAME, m.kind)
        # a run of one placeholder is one token
        same = np.zeros(n, bool)
        if n:
            same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] > 0) & (doc[1:] == doc[:-1])
        keep = np.flatnonzero(~same)
        self.kind = kind[keep]
        run = np.cumsum(~same) - 1
        place = np.arange(n) - keep[run] if n else np.zeros(0, np.int64)
        self.value = np.zeros(len(keep), np.uint64)
        np.add.at(self.value, run, mix(w.hash + place.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
        self.hash = np.where(self.kind == PLAIN, w.hash[keep], mix(self.kind.astype(np.uint64) + U64(17)))
        self.values = mix(self.value + U64(5))
        self.start = w.start[keep]
        last = np.r_[keep[1:], n] - 1 if n else keep
        self.end = w.end[last] if n else w.end
        self.first = np.searchsorted(self.start, w.off)
        # names and lower-case words up to each token
        self.names, self.lower = (np.concatenate([[0], np.cumsum(x)])[np.r_[keep, n]] for x in (name, m.lower))

    def text(self, i: int) -> str:
        return " ".join(self.bytes[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace").split())

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first token, hash) of all windows of ``size`` tokens within a text."""
        count = np.maximum(np.diff(self.first) - size + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + self.first[:-1][doc]
        plain = np.concatenate([[0], np.cumsum(self.kind == PLAIN)])
        exact = plain[at + size] - plain[at] < min(LITERALS, size)
        h = np.full(len(at), size + (self.form << 16), np.uint64)
        # few windows need the values
        some = np.flatnonzero(exact)
        literal, first = h[some], at[some]
        for j in range(size):
            mult = U64(pow(0x9E3779B97F4A7C15, j + 2, 1 << 64))
            h += (self.hash * mult)[at + j]
            literal += self.values[first + j] * mult
        h[some] = literal
        return doc, at, mix(h)

    def caseless(self, at: np.ndarray, size: int) -> np.ndarray:
        """Whether the window at each token is all in lower, or all in upper or title case, so that capitals tell no names."""
        return (self.names[at + size] == self.names[at]) | (self.lower[at + size] == self.lower[at])


def _windows(df: DataFrame, key: str, sizes: list[int] | None, bitmap=None) -> DataFrame:
    """Windows of the texts of ``df``: key, digest (of the text), pos, n (tokens of the text), form, size, hash, slots (offset in the
    window, kind, value). A text that a task has met under the same key is left out.

    sizes None: of benchmark items, the windows of ``_sizes``. bitmap: only windows that hit it, the
    literal ones only where capitals tell no names."""
    def run(batches):
        marks = _hashes(UNITS), _hashes(NUMBERS), _hashes(SMALL)
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None
        met: set = set()
        for b in slices(batches, "text", 1 << 19):
            m = Marked(*flat_bytes(b.column(1)), *marks)
            keys, digest, cols = b.column(0), {}, {x: [] for x in ("doc", "pos", "n", "form", "size", "hash", "slots", "at", "kind", "value")}
            for form in FORMS:
                t = Tokens(m, form)
                length = np.diff(t.first)
                of = {int(x): _sizes(int(x)) for x in np.unique(length) if x} if sizes is None else {}
                for size in sizes if sizes is not None else sorted(set().union(*of.values())):
                    doc, at, h = t.windows(size)
                    if sizes is None:
                        ok = np.array([size in of.get(int(x), ()) for x in length], bool)[doc]
                    else:
                        slot = (h >> U64(64 - BITMAP_BITS)).astype(np.int64)
                        ok = bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
                        if form == LITERAL:
                            ok &= t.caseless(at, size)
                    doc, at, h = doc[ok], at[ok], h[ok]
                    for i in np.unique(doc).tolist():
                        if i not in digest:
                            text = hashlib.md5(b.column(1)[i].as_buffer().to_pybytes()).digest()
                            mark = keys[i].as_py(), text
                            digest[i] = None if mark in met else text
                            if len(met) < MET:
                                met.add(mark)
                    fresh = np.array([digest[i] is not None for i in doc.tolist()], bool)
                    doc, at, h = doc[fresh], at[fresh], h[fresh]
                    if not len(doc):
                        continue
                    # each token's text once, however many windows hold it
                    row, j = np.nonzero(t.kind[at[:, None] + np.arange(size)])
                    token, where = np.unique(at[row] + j, return_inverse=True)
                    for name, x in (("doc", doc), ("pos", at - t.first[:-1][doc]), ("n", length[doc]), ("form", np.full(len(doc), form)), ("size", np.full(len(doc), size)),
                                    ("hash", h.view(np.int64)), ("slots", np.bincount(row, minlength=len(doc))), ("at", j), ("kind", t.kind[at[row] + j])):
                        cols[name].append(x)
                    cols["value"].append(pa.array([t.text(i) for i in token.tolist()], pa.string()).take(pa.array(where, pa.int64())))
            if not cols["doc"]:
                continue
            value = pa.concat_arrays(cols.pop("value"))
            cols = {k: np.concatenate(v) for k, v in cols.items()}
            slots = pa.StructArray.from_arrays([pa.array(cols["at"], pa.int32()), pa.array(_KINDS).take(pa.array(cols["kind"])), value], names=["at", "kind", "value"])
            ends = np.concatenate([[0], np.cumsum(cols["slots"])])
            yield pa.RecordBatch.from_arrays([
                keys.take(pa.array(cols["doc"], pa.int64())), pa.array([digest[i] for i in cols["doc"].tolist()], pa.binary()), pa.array(cols["pos"], pa.int64()), pa.array(cols["n"], pa.int64()),
                pa.array(cols["form"], pa.int32()), pa.array(cols["size"], pa.int32()), pa.array(cols["hash"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), slots)],
                names=[key, "digest", "pos", "n", "form", "size", "hash", "slots"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "text").mapInArrow(
        run, f"{key} {kind}, digest binary, pos long, n long, form int, size int, hash long, slots array<struct<at:int,kind:string,value:string>>")


def contaminated(docs: DataFrame, bench: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document text and benchmark item it contains: doc_id, item_id, matched (windows of the item found on the
    best band of diagonals, of its best form and size), n_windows, coverage, n_slots (distinct slot values of the item seen), n_changed (of them with another
    value in the document). A pair counts if coverage >= ``least`` without the windows that hold a value of the item that
    is not the same throughout the document's copy."""
    return _contaminated(docs, bench, least).drop("digest", "idigest")


def _contaminated(docs: DataFrame, bench: DataFrame, least: float) -> DataFrame:
    """``contaminated`` with the digests of both texts."""
    spark = importable(docs.sparkSession)
    items = _windows(bench, "item_id", None).dropDuplicates(["item_id", "digest", "pos", "hash"]).persist()
    try:
        sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most WINDOW values
        word = F.expr(f"shiftrightunsigned(hash, {64 - BITMAP_BITS})")
        # at most 2^BITMAP_BITS / 8 rows of a byte each
        on = items.select(F.shiftright(word, 3).alias("w"), F.expr("shiftleft(1, cast(%s & 7 AS int))" % f"shiftrightunsigned(hash, {64 - BITMAP_BITS})").alias("b"))
        rows = on.groupBy("w").agg(F.bit_or("b").alias("b")).collect()
        bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
        for r in rows:
            bits[r.w] = r.b
    finally:
        items.unpersist()
    bc = spark.sparkContext.broadcast(bits.tobytes())
    d = _windows(docs, "doc_id", sorted(sizes), bc)
    i = items.select("item_id", F.col("digest").alias("idigest"), F.col("pos").alias("ipos"), "form", F.col("n").alias("in"), F.col("size").alias("isize"), "hash", F.col("slots").alias("islots"))
    hit = d.select("doc_id", "digest", "pos", "hash", "slots").join(i, "hash")
    hit = hit.withColumn("diag", F.col("pos") - F.col("ipos")).repartition("digest", "idigest")
    hit = hit.withColumn("band", F.explode(F.expr(f"array(2 * floor(diag / {BAND}), 2 * floor((diag + {BAND // 2}) / {BAND}) + 1)")))
    pair = ["doc_id", "digest", "item_id", "idigest"]
    by = [*pair, "form", "isize", "band"]
    # a window of the item counts with one of the document and the other way round, on the diagonal with most of them
    hit = hit.withColumn("_v", F.count("*").over(W.partitionBy(*by, "diag")))
    for one, other in (("ipos", "pos"), ("pos", "ipos")):
        hit = hit.withColumn("_r", F.row_number().over(W.partitionBy(*by, one).orderBy(F.desc("_v"), F.abs("diag"), "diag", other))).where("_r = 1")
    # one row per window and slot (a window without slots has one): values of a position are equal in all windows that hold it
    slot = hit.select(*by, "ipos", "in", F.explode_outer(F.arrays_zip("islots", "slots")).alias("z"))
    slot = slot.select(*by, "ipos", "in", F.concat_ws(":", "z.islots.kind", "z.islots.value").alias("was"),
                       F.concat_ws(":", "z.slots.kind", "z.slots.value").alias("now"))
    values = slot.groupBy(*by, "was").agg(F.min("now").alias("lo"), F.max("now").alias("hi"),
                                          F.collect_set("ipos").alias("at"), F.max("in").alias("in"))
    values = values.withColumn("_c", F.col("lo") != F.col("hi"))
    at = [F.array_distinct(F.flatten(F.collect_list(x))) for x in ("at", F.when(F.col("_c"), F.col("at")))]
    pairs = values.groupBy(*by).agg(
        F.size(F.array_except(*at)).alias("matched"),
        F.max(F.col("in") - F.col("isize") + 1).alias("n_windows"), F.max("in").alias("in"),
        F.count_if(F.col("was") != "").alias("n_slots"),
        F.count_if((F.col("lo") != F.col("was")) | F.col("_c")).alias("n_changed"),
        F.count_if("_c").alias("n_conflicts"))
    # smaller windows, of which a conflict takes away fewer, count only without one
    pairs = pairs.where(f"matched > 0 AND (n_conflicts = 0 OR isize = least(in, {WINDOW}))")
    pairs = pairs.withColumn("coverage", F.col("matched") / F.col("n_windows")).where(F.col("coverage") >= least)
    best = W.partitionBy(*pair).orderBy(F.desc("coverage"), F.desc("isize"), "n_changed", "form", "band")
    pairs = pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return pairs.select(*pair, "matched", "n_windows", "coverage", "n_slots", "n_changed")


def keep_clean(docs: DataFrame, bench: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item. The list of (id, text digest) to drop is broadcast if it is short."""
    ident, digest = unused("_id", docs), unused("_digest", docs)
    bad = written(_contaminated(docs, bench, least).select(F.col("doc_id").alias(ident), F.lower(F.hex("digest")).alias(digest)).distinct(), "op5-bad")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.md5(F.col("text").cast("binary")) == F.col(digest)), "left_anti")
