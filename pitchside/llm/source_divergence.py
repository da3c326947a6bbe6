"""Operator 13: source divergence audit by duplicate-text collapse.

Equal texts of a language become one row with a multiplicity per source; each is
cut into terms once, and its counts and document frequencies are added with those
multiplicities. A language keeps the terms that occur in at least ``min_docs`` of its
documents. Every (lang, source) group and every language gives each kept term the
share ``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, and two shares
differ by ``f(p, q) = floor((p - q)^2 / (p + q))``, all in whole numbers.

The sum of f over all kept terms for two sources s and t is evaluated sparsely. With
the share ``z`` of a term that a source lacks it is

    V * f(z_s, z_t) + H(s, t) + H(t, s) + G(s, t)
    H(s, t) = sum over the terms of s of f(p_s, z_t) - f(z_s, z_t)
    G(s, t) = sum over the terms of both of f(p_s, p_t) - f(p_s, z_t) - f(z_s, p_t) + f(z_s, z_t)

H needs only how often each share occurs in s (a source has few different counts). G
meets only the sources of one term, held in blocks of ``SOURCES`` sources: a row is one
term with one block or two, and its pairs are added up in arrays, never emitted.

What travels: every different text once (after equal ones of a task are merged), narrow
rows (lang, digest, source), and per task one row for each (lang, source, term).

Edge cases: null text, lang and source are read as ''; a text without a term counts as a
document and makes its group occur; a language without a kept term has pairs of value 0
and no term rows; a source alone in its language has no pairs; repeated rows count as
often as they occur; ties go to the smaller item in UTF-8 order; very long texts are cut
into terms whole (a text is one row, as everywhere in Spark); extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions.sql import run_sql
from pitchside.llm.common import importable, written

#: Documents a kept term occurs in at least, scale of the shares, prior count of every kept term, ranks of the term part.
MIN_DOCS, SCALE, PRIOR, TOP = 10, 1_000_000_000, 2, 10
#: Sources of a block, parts of a source's histogram of shares.
SOURCES, HIST_PARTS = 256, 4
#: Distinct (lang, source, term) rows a task holds before it passes them on.
HELD = 400_000

#: Everything but ASCII letters and bytes of non-ASCII characters becomes a blank, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, sources array<struct<source, copies>>): each different text of a language once."""
    d = docs.selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "coalesce(text, '') AS text").selectExpr("*", "unhex(sha2(text, 256)) AS digest")
    return run_sql({"d": d}, """
        SELECT t.lang, t.text, m.sources FROM
          (SELECT lang, digest, any_value(text) AS text FROM {d} GROUP BY lang, digest) t JOIN
          (SELECT lang, digest, collect_list(struct(source, copies)) AS sources
           FROM (SELECT lang, digest, source, count(*) AS copies FROM {d} GROUP BY lang, digest, source) GROUP BY lang, digest) m
          ON t.lang = m.lang AND t.digest = m.digest""")


def _term_rows(batches):
    """(lang, term, source, n, docs): occurrences and documents, added up over the different texts of a task."""
    held: dict = {}

    def flush():
        keys, sums = list(held), list(held.values())
        held.clear()
        for at in range(0, len(keys), 50_000):
            k, v = keys[at:at + 50_000], sums[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in k], pa.string()), pa.array([x[2] for x in k], pa.binary()).cast(pa.string()), pa.array([x[1] for x in k], pa.string()),
                 pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v], pa.int64())], names=["lang", "term", "source", "n", "docs"])

    for batch in batches:
        lang, sources = batch.column("lang").to_pylist(), batch.column("sources").to_pylist()
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            found = Counter(terms(text.as_py()))
            for s in sources[i]:
                copies, source = s["copies"], s["source"]
                for term, n in found.items():
                    key = (lang[i], source, term)
                    was = held.get(key)
                    held[key] = (n * copies, copies) if was is None else (was[0] + n * copies, was[1] + copies)
                if len(held) > HELD:
                    yield from flush()
    yield from flush()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n): occurrences of the kept terms in each group that has them, and in the language."""
    rows = collapsed(docs).mapInArrow(_term_rows, "lang string, term string, source string, n long, docs long").repartition("lang", "term")
    return run_sql({"r": rows}, f"""
        SELECT lang, term, source, n, lang_n FROM
          (SELECT *, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(docs) OVER (PARTITION BY lang, term) AS lang_docs
           FROM (SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM {{r}} GROUP BY lang, term, source))
        WHERE lang_docs >= {min_docs}""")


def _share(n: str, total: str, v: str) -> str:
    return f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {PRIOR} AS DECIMAL(20,0))) div CAST({total} + {PRIOR} * {v} AS DECIMAL(20,0))"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _sums(lang: str, source: list, item: list, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(v, pa.int64())],
                                      names=["lang", "source", "item", "v"])


def _histogram_sums(batches):
    """For a source s and a block of sources t: V * f(z_s, z_t) for (s, t) (rows without shares), or H(s, t) for (s, t) and (t, s)."""
    for batch in batches:
        for r in batch.to_pylist():
            items = [t["source"] for t in r["block"]]
            other = [i for i, t in enumerate(items) if t != r["source"]]
            items = [items[i] for i in other]
            z = np.array([t["z"] for t in r["block"]], np.int64)[other]
            base = _f(np.int64(r["z"]), z)
            here = [r["source"]] * len(items)
            if r["shares"] is None:
                yield _sums(r["lang"], here, items, base * r["v"])
            else:
                p, n = (np.array([x[k] for x in r["shares"]], np.int64) for k in ("p", "n"))
                h = sum((((_f(p[i:i + 4096, None], z) - base) * n[i:i + 4096, None]).sum(axis=0) for i in range(0, len(p), 4096)), np.zeros(len(items), np.int64))
                yield _sums(r["lang"], here, items, h)
                yield _sums(r["lang"], items, here, h)


def _common_sums(batches):
    """(lang, a, b, s, t, v): G of source s of block a and t of block b over the terms of a task; rows are sorted by (lang, a, b)."""
    key, total = None, None

    def done():
        s, t = np.nonzero(total)
        if key[1] == key[2]:
            s, t = s[s != t], t[s != t]
        n = len(s)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1]), pa.int32()), pa.array(np.full(n, key[2]), pa.int32()),
                                           pa.array(s, pa.int32()), pa.array(t, pa.int32()), pa.array(total[s, t], pa.int64())], names=["lang", "a", "b", "s", "t", "v"])

    for batch in batches:
        lang, a, b = (batch.column(c).to_pylist() for c in ("lang", "a", "b"))
        sides = []
        for side in ("l", "r"):
            flat = batch.column(side).flatten()
            sides.append((np.asarray(batch.column(side).offsets) - batch.column(side).offsets[0].as_py(), *(np.asarray(flat.field(c)) for c in ("at", "p", "z"))))
        (lo, ls, lp, lz), (ro, rs, rp, rz) = sides
        for i in range(len(batch)):
            if (lang[i], a[i], b[i]) != key:
                if key is not None:
                    yield done()
                key, total = (lang[i], a[i], b[i]), np.zeros((SOURCES, SOURCES), np.int64)
            x, y = slice(lo[i], lo[i + 1]), slice(ro[i], ro[i + 1])
            p, z, q, w = lp[x, None], lz[x, None], rp[y], rz[y]
            total[ls[x, None], rs[y]] += _f(p, q) - _f(p, w) - _f(z, q) + _f(z, w)
    if key is not None:
        yield done()


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by their divergence
    from the source, part ``term`` the ``top`` kept terms that the source uses more than its language."""
    importable(docs.sparkSession)
    kept = written(kept_terms(docs, min_docs), "divergence-terms")
    groups = docs.selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source").distinct()
    totals = written(run_sql({"k": kept, "g": groups}, f"""
        SELECT g.lang, g.source, v, n, lang_n, IF(v = 0, 1, {_share('0', 'n', 'greatest(v, 1)')}) AS z, CAST(num div {SOURCES} AS INT) AS block, CAST(num % {SOURCES} AS INT) AS at
        FROM (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(s.n, 0) AS n, coalesce(l.n, 0) AS lang_n, row_number() OVER (PARTITION BY g.lang ORDER BY g.source) - 1 AS num
              FROM {{g}} g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM {{k}} GROUP BY lang, source) s ON g.lang = s.lang AND g.source = s.source
              LEFT JOIN (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM (SELECT DISTINCT lang, term, lang_n FROM {{k}}) GROUP BY lang) l ON g.lang = l.lang) g"""), "divergence-totals")
    shares = written(run_sql({"k": kept, "t": totals}, f"""
        SELECT k.lang, k.term, k.source, t.block, t.at, t.z, {_share('k.n', 't.n', 't.v')} AS p, {_share('k.lang_n', 't.lang_n', 't.v')} AS q
        FROM {{k}} k JOIN {{t}} t ON k.lang = t.lang AND k.source = t.source"""), "divergence-shares")
    blocks = run_sql({"t": totals}, "SELECT lang, block AS b, collect_list(struct(source, z)) AS block FROM {t} GROUP BY lang, block")
    hist = run_sql({"s": shares, "t": totals, "b": blocks}, f"""
        SELECT h.*, b.block FROM
          (SELECT lang, source, z, v, CAST(NULL AS ARRAY<STRUCT<p: BIGINT, n: BIGINT>>) AS shares FROM {{t}} UNION ALL
           SELECT lang, source, z, 0L, collect_list(struct(p, n)) FROM (SELECT lang, source, z, p, count(*) AS n FROM {{s}} GROUP BY lang, source, z, p)
           GROUP BY lang, source, z, p % {HIST_PARTS}) h
          JOIN {{b}} b ON h.lang = b.lang""").mapInArrow(_histogram_sums, "lang string, source string, item string, v long")
    common = run_sql({"s": shares}, """
        SELECT lang, x.block AS a, y.block AS b, x.found AS l, y.found AS r
        FROM (SELECT lang, blocks, explode(blocks) AS x FROM
                (SELECT lang, term, collect_list(struct(block, found)) AS blocks
                 FROM (SELECT lang, term, block, collect_list(struct(at, p, z)) AS found FROM {s} GROUP BY lang, term, block) GROUP BY lang, term))
             LATERAL VIEW explode(filter(blocks, o -> o.block >= x.block)) t AS y""")
    common = common.sortWithinPartitions("lang", "a", "b").mapInArrow(_common_sums, "lang string, a int, b int, s int, t int, v long")
    return run_sql({"h": hist, "c": common, "t": totals, "s": shares}, f"""
        SELECT lang, source, 'pair' AS part, item, v AS value, row_number() OVER (PARTITION BY lang, source ORDER BY v DESC, item) AS rank
        FROM (SELECT lang, source, item, sum(v) AS v FROM (SELECT * FROM {{h}} UNION ALL SELECT * FROM {{pairs}}) GROUP BY lang, source, item)
        UNION ALL
        SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) div (p + q) AS value,
                              row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) div (p + q) DESC, term) AS rank
                       FROM {{s}} WHERE p > q) WHERE rank <= {top}""", steps=[
        ("g", "SELECT lang, a, b, s, t, sum(v) AS v FROM {c} GROUP BY lang, a, b, s, t"),
        ("named", "SELECT g.lang, g.a, g.b, x.source AS source, y.source AS item, g.v FROM {g} g JOIN {t} x ON g.lang = x.lang AND g.a = x.block AND g.s = x.at "
                  "JOIN {t} y ON g.lang = y.lang AND g.b = y.block AND g.t = y.at"),
        # a block met with itself holds both orders already
        ("pairs", "SELECT lang, o.source, o.item, v FROM (SELECT lang, v, explode(IF(a = b, array(struct(source, item)), "
                  "array(struct(source, item), struct(item AS source, source AS item)))) AS o FROM {named})")])
