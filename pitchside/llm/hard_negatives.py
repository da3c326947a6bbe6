"""Operator 12: hard negatives by segment summary filtering.

Vectors are quantised to whole numbers, floor(SCALE * x), and a score is the integer
inner product. Every vector is cut into segments at several lengths (``SEGMENTS``,
coarse to fine) and each segment's mean and deviation are kept. With segment length L,
means m and deviations D (root of the summed squares about the mean) a score lies within

    sum over segments of  L * m_x * m_y  -+  D_x * D_y

An anchor meets the rows block by block. A pair whose bounds miss what the anchor still
looks for is dropped; those that remain are bounded with the next shorter segments, and
the last ones are scored exactly. What an anchor looks for: for positives, scores of at
least its worst best one so far; for negatives, scores inside the band that a positive's
score allows and at least the worst best one of that band so far. Bounds only ever drop
pairs that cannot be answers, so the result is exact.

Both searches run as streams: blocks of anchors (at most ``ANCHOR_ROWS``) times groups of
rows are dealt to tasks by number; a task holds one block of anchors with their best
answers while the rows of its group pass by in batches. It returns only best answers.

Equal rows (label and vector) are one class with its smallest ids, so many copies are
scored once. Copies among the anchors are units of about ``UNIT_IDS`` ids that are searched
once each. No label is a key of a shuffle, so a hot label is not a hot task.

Edge cases: null ids, labels, vectors, vectors with a null or non-finite component and
empty vectors take no part, nor do those whose quantised norm is 2^28 or more (their
scores, times the percentages, are no longs); vectors of different lengths are never compared; repeated rows of
one id, label and vector count once; rows of one id with different labels or vectors are
different rows; ties go to the smaller id; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions.sql import run_sql
from pitchside.llm.common import importable, parallelism, written

#: Factor before flooring, lengths of the segments, positives of an anchor, negatives of a positive, percentages of the
#: positive's score that bound a negative's score.
SCALE, SEGMENTS, POSITIVES, NEGATIVES, LOW, HIGH = 256, (16, 4, 2), 5, 10, 30, 90
#: Anchors of a block, of a tile that meets a batch at once, ids of a unit; share of open pairs below which pairs are taken singly.
ANCHOR_ROWS, TILE, UNIT_IDS, SPARSE = 8_192, 512, 5_000, 0.02
#: No score so far; more than any score.
_NONE, _MOST = np.iinfo(np.int64).min, np.int64(2 ** 62)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q array<int>) of the rows that take part, each once."""
    v = vectors.selectExpr("vec_id", "label", "CAST(embedding AS ARRAY<DOUBLE>) AS v").where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.where(f"forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs({scale}D * x) < 2147483647D)")
    v = v.where(f"aggregate(v, 0D, (a, x) -> a + floor({scale}D * x) * floor({scale}D * x)) < 72057594037927936D")
    return v.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(label AS BIGINT) AS label", f"transform(v, x -> CAST(floor({scale}D * x) AS INT)) AS q").distinct()


class Vectors:
    """A block of quantised vectors of one length with the summaries of their segments."""

    def __init__(self, q: np.ndarray):
        self.q = q.astype(np.float64)
        self.norm = np.sqrt((self.q * self.q).sum(axis=1))
        self.levels = []
        dim = q.shape[1]
        for length in (n for n in SEGMENTS if n < dim):
            starts = np.arange(0, dim, length)
            size = np.minimum(length, dim - starts)
            mean = np.add.reduceat(self.q, starts, axis=1) / size
            rest = self.q - np.repeat(mean, size, axis=1)
            self.levels.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))))

    def part(self, rows) -> "Vectors":
        got = object.__new__(Vectors)
        got.q, got.norm, got.levels = self.q[rows], self.norm[rows], [(m[rows], d[rows]) for m, d in self.levels]
        return got


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of matching rows; sums that doubles cannot hold are formed as whole numbers."""
    s = np.einsum("pk,pk->p", x, y)
    big = np.einsum("pk,pk->p", np.abs(x), np.abs(y)) >= 2.0 ** 52
    out = np.where(big, 0, s).astype(np.int64)
    if big.any():
        out[big] = np.einsum("pk,pk->p", x[big].astype(np.int64), y[big].astype(np.int64))
    return out


def scored(x: Vectors, y: Vectors, may: np.ndarray, low: np.ndarray, high: np.ndarray, seen: list[int] | None = None):
    """(i, j, score) of the pairs of x and y that ``may`` allows and whose score lies from low[i] to high[i].

    seen: pairs open before each level and before exact scoring are added to it."""
    may = may.copy()
    # scores are whole numbers; a quarter and a little more leaves room for the rounding of the bounds
    for (xm, xd), (ym, yd) in zip(x.levels, y.levels):
        if seen is not None:
            seen.append(np.count_nonzero(may))
        if np.count_nonzero(may) > SPARSE * may.size:
            mid, dev = xm @ ym.T, xd @ yd.T
            dev += 0.25 + 1e-9 * x.norm[:, None] * y.norm
            may &= (mid + dev >= low[:, None]) & (mid - dev <= high[:, None])
        else:
            i, j = np.nonzero(may)
            mid, dev = np.einsum("pk,pk->p", xm[i], ym[j]), np.einsum("pk,pk->p", xd[i], yd[j]) + 0.25 + 1e-9 * x.norm[i] * y.norm[j]
            out = (mid + dev < low[i]) | (mid - dev > high[i])
            may[i[out], j[out]] = False
    i, j = np.nonzero(may)
    if seen is not None:
        seen.append(len(i))
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    if len(i) > SPARSE * may.size and x.norm.max() * y.norm.max() < 2.0 ** 52:
        s = (x.q @ y.q.T)[i, j].astype(np.int64)
    else:
        s = np.concatenate([exact_scores(x.q[i[a:a + 100_000]], y.q[j[a:a + 100_000]]) for a in range(0, len(i), 100_000)])
    ok = (s >= low[i]) & (s <= high[i])
    return i[ok], j[ok], s[ok]


class Best:
    """The k best (score, id) of each of n searches: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.own = np.zeros((n, k), bool)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ident: np.ndarray, own: np.ndarray) -> None:
        if not len(at):
            return
        rows = np.unique(at)
        at = np.concatenate([np.repeat(rows, self.k), at])
        score, ident = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.id[rows].ravel(), ident])
        own = np.concatenate([self.own[rows].ravel(), own])
        order = np.lexsort((ident, -np.maximum(score, -_MOST), at))
        at, score, ident, own = at[order], score[order], ident[order], own[order]
        first = np.searchsorted(at, rows)
        take = first[:, None] + np.arange(self.k)
        self.score[rows], self.id[rows], self.own[rows] = score[take], ident[take], own[take]

    def found(self):
        """(search, score, id, own) of all answers."""
        i, j = np.nonzero(self.score != _NONE)
        return i, self.score[i, j], self.id[i, j], self.own[i, j]


class Anchors:
    """A block of anchors of one vector length, their bands (none: a search for positives) and best answers."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, positives: int, negatives: int):
        t = pa.Table.from_batches(batches)
        self.a, self.label = np.asarray(t.column("a")), np.asarray(t.column("label"))
        self.v = Vectors(_matrix(t.column("q"), dim))
        bands = t.column("bands").to_pylist()
        self.mining = bands[0] is not None
        self.keep = negatives if self.mining else positives + 1
        if self.mining:
            width = max(len(b) for b in bands)
            self.ps = np.array([b + [0] * (width - len(b)) for b in bands], np.int64).reshape(len(bands), width)
            there = np.arange(width) < np.array([len(b) for b in bands])[:, None]
            # floor divisions of whole numbers; -(-x // y) rounds up
            self.lo = np.where(there, -(-LOW * self.ps // 100), _MOST)
            self.hi = np.where(there, HIGH * self.ps // 100, -_MOST)
            self.lo = np.where(self.lo <= self.hi, self.lo, _MOST)
            self.best = [Best(len(self.a), self.keep) for _ in range(width)]
        else:
            self.best = [Best(len(self.a), self.keep)]
        self.order = np.argsort(self.label, kind="stable")

    def meet(self, batch: pa.RecordBatch, dim: int) -> None:
        y, label = Vectors(_matrix(batch.column("q"), dim)), np.asarray(batch.column("label"))
        ids = batch.column("ids")
        id_off = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        id_of, n_ids = np.asarray(ids.flatten()), np.diff(id_off)
        n_ids = np.minimum(n_ids, self.keep)
        for s in range(0, len(self.order), TILE):
            rows = self.order[s:s + TILE]
            x, same = self.v.part(rows), self.label[rows][:, None] == label
            if self.mining:
                low = np.stack([np.maximum(self.lo[rows, b], best.worst()[rows]) for b, best in enumerate(self.best)])
                i, j, score = scored(x, y, ~same, low.min(axis=0), np.where(self.lo[rows] < _MOST, self.hi[rows], -_MOST).max(axis=1))
            else:
                i, j, score = scored(x, y, same, self.best[0].worst()[rows], np.full(len(rows), _MOST))
            for b, best in enumerate(self.best):
                fits = (score >= low[b, i]) & (score <= self.hi[rows[i], b]) if self.mining else slice(None)
                self._take(best, rows[i[fits]], j[fits], score[fits], y, n_ids, id_off, id_of)

    def _take(self, best: Best, at, j, score, y, n_ids, id_off, id_of) -> None:
        """Add the classes j of the batch, with their smallest ids, to the answers of the anchors ``at``."""
        if len(at) > 4 * self.keep:
            # only the best classes of each anchor can give answers
            order = np.lexsort((-score, at))
            a = at[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            first = np.flatnonzero(place == 0)
            worst = np.minimum.reduceat(np.where(place < self.keep, score[order], _MOST), first)
            ok = score[order] >= np.repeat(worst, np.diff(np.append(first, len(a))))
            at, j, score = at[order[ok]], j[order[ok]], score[order[ok]]
        n = n_ids[j]
        own = np.zeros(len(at), bool) if self.mining else (self.v.q[at] == y.q[j]).all(axis=1)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        best.add(np.repeat(at, n), np.repeat(score, n), id_of[np.repeat(id_off[j], n) + within], np.repeat(own, n))

    def answers(self):
        for b, best in enumerate(self.best):
            i, score, ident, own = best.found()
            ps = self.ps[i, b] if self.mining else np.zeros(len(i), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(self.a[i]), pa.array(ps), pa.array(score), pa.array(ident), pa.array(own)], names=["a", "ps", "score", "vec_id", "own"])


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten()).reshape(-1, dim)


def _search(positives: int, negatives: int):
    def run(batches):
        key, waiting, block = None, [], None
        for batch in batches:
            unit, dim, kind = (np.asarray(batch.column(c)) for c in ("unit", "dim", "kind"))
            cuts = np.flatnonzero((np.diff(unit) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(unit)]):
                if s == e:
                    continue
                if (unit[s], dim[s]) != key:
                    if block is not None:
                        yield from block.answers()
                    key, waiting, block = (unit[s], dim[s]), [], None
                part = batch.slice(int(s), int(e - s))
                if kind[s] == 0:
                    waiting.append(part)
                elif waiting or block is not None:
                    if block is None:
                        block, waiting = Anchors(waiting, int(dim[s]), positives, negatives), []
                    block.meet(part, int(dim[s]))
        if block is not None:
            yield from block.answers()
    return run


def _best(anchors: DataFrame, classes: DataFrame, blocks: int, positives: int, negatives: int) -> DataFrame:
    """(a, ps, score, vec_id, own): the best answers of the tasks for anchors (a, label, q, bands)."""
    spark = anchors.sparkSession
    groups = max(1, -(-2 * parallelism(spark) // blocks))
    met = run_sql({"a": anchors, "c": classes}, f"""
        SELECT CAST(pmod(xxhash64(a), {blocks}) * {groups} AS INT) + g AS unit, size(q) AS dim, 0 AS kind, a, label, q, bands, CAST(NULL AS ARRAY<BIGINT>) AS ids
        FROM {{a}} LATERAL VIEW explode(sequence(0, {groups - 1})) t AS g
        UNION ALL
        SELECT b * {groups} + CAST(pmod(xxhash64(label, q), {groups}) AS INT), size(q), 1, 0L, label, q, CAST(NULL AS ARRAY<BIGINT>), ids
        FROM {{c}} LATERAL VIEW explode(sequence(0, {blocks - 1})) t AS b""")
    met = met.repartitionById(blocks * groups, F.col("unit")).sortWithinPartitions("unit", "dim", "kind")
    return met.mapInArrow(_search(positives, negatives), "a long, ps long, score long, vec_id long, own boolean")


def mined(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, embedding) of ``anchors`` among ``vectors``."""
    importable(vectors.sparkSession)
    keep = max(positives + 1, negatives)
    classes = written(run_sql({"r": quantised(vectors)}, f"""
        SELECT label, q, sort_array(collect_list(vec_id)) AS ids
        FROM (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY vec_id) AS n FROM {{r}}) WHERE n <= {keep} GROUP BY label, q"""), "negatives-classes")
    rows = written(quantised(anchors), "negatives-anchors")
    n = rows.count()
    units = written(run_sql({"r": rows}, f"""
        SELECT monotonically_increasing_id() AS a, label, q, anchor_ids
        FROM (SELECT label, q, collect_list(vec_id) AS anchor_ids FROM {{r}} GROUP BY label, q, pmod(xxhash64(vec_id), {max(1, n // UNIT_IDS)}))"""), "negatives-units")
    blocks = max(1, -(-units.count() // ANCHOR_ROWS))
    near = _best(units.selectExpr("a", "label", "q", "CAST(NULL AS ARRAY<BIGINT>) AS bands"), classes, blocks, positives, negatives)
    near = written(run_sql({"n": near}, f"""
        SELECT a, transform(sort_array(collect_list(struct(-score AS s, vec_id, own))), x -> struct(-x.s AS score, x.vec_id AS vec_id, x.own AS own)) AS near
        FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS n FROM {{n}}) WHERE n <= {positives + 1} GROUP BY a"""), "negatives-positives")
    # a unit of one anchor does not need the band of the anchor's own score
    banded = run_sql({"u": units, "n": near}, """
        SELECT * FROM (SELECT u.a, u.label, u.q, array_distinct(filter(near, x -> NOT (x.own AND size(anchor_ids) = 1 AND x.vec_id = anchor_ids[0])).score) AS bands
                       FROM {u} u JOIN {n} n ON u.a = n.a) WHERE size(bands) > 0""")
    far = _best(banded, classes, blocks, positives, negatives)
    return run_sql({"u": units, "n": near, "f": far}, f"""
        SELECT p.anchor_id, p.near.vec_id AS positive_id, o.n AS rank, o.vec_id AS negative_id, p.near.score AS positive_score, o.score AS negative_score
        FROM (SELECT a, anchor_id, explode(slice(filter(near, x -> NOT (x.own AND x.vec_id = anchor_id)), 1, {positives})) AS near
              FROM (SELECT u.a, explode(u.anchor_ids) AS anchor_id, n.near FROM {{u}} u JOIN {{n}} n ON u.a = n.a)) p
        JOIN (SELECT * FROM (SELECT a, ps, score, vec_id, row_number() OVER (PARTITION BY a, ps ORDER BY score DESC, vec_id) AS n FROM {{f}}) WHERE n <= {negatives}) o
          ON p.a = o.a AND p.near.score = o.ps""")
