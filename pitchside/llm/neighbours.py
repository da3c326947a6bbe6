"""Operator 9: nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected by a few Gaussian directions (2-stable: the squared
projected distance over the squared true distance follows a chi-square
distribution). A kd-tree over the projections yields neighbours of a projected
query nearest first; each is verified on the original vectors, until the
chi-square test says that with probability ``CONFIDENCE`` no unseen vector is
nearer than the worst of the answers so far.

Largest inner product becomes nearest distance by one more component,
sqrt(M^2 - |x|^2) for a vector and 0 for a query, where M is the largest norm.

The vectors are dealt into cells by the upper levels of one kd-tree, fitted on a
bounded sample; cells that got more than ``CELL_ROWS`` vectors are split again by their own
quantiles along their widest side until none has more, whatever the size of the
table. Every cell builds its own tree in its task. A query first visits
the nearest cell and takes its worst answer from there. Then the same
chi-square radius decides which other cells it must visit; boxes and queries meet in
blocks. Cells meet blocks of queries; no pair of rows is made that was not within the radius.
The driver and the tasks hold the boxes of the cells: 136 bytes for some ``CELL_ROWS`` vectors.

Equal vectors are one point of the index with its smallest ids, so many copies
are neither compared again nor dealt to one task.

Edge cases: vectors that are null, zero, of another length than most, or hold a
null or non-finite component take no part; null ids take no part; repeated rows
of one id and vector are one candidate; ties go to the smaller id; with fewer
than k candidates all are returned; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchside.llm.common import importable, written

#: Projected dimensions, confidence of the stopping test, points of a leaf, most vectors of the sample that fits the
#: cells, vectors of a cell and queries of a block that are aimed at.
DIMS, CONFIDENCE, LEAF, SAMPLE, CELL_ROWS, QUERY_ROWS = 8, 0.5, 256, 20_000, 16_384, 1_024
#: Parts a cell is split into at most in one round, rounds by quantiles (then by hash: equal projections cannot be parted),
#: vectors of the sample for a cell, queries and boxes that meet at once, ids that ask for one search.
PARTS, QUANTILE_ROUNDS, SAMPLE_PER_CELL, MEET_QUERIES, MEET_BOXES, UNIT_IDS = 64, 4, 16, 256, 4_096, 5_000


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square with an even number m of degrees <= x) = p, by bisection of the closed form."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


def good_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, norm) of the rows that take part."""
    v = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    return v.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


class Tree:
    """kd-tree over projected points: median splits along the widest side, leaves with bounding boxes."""

    def __init__(self, y: np.ndarray, leaf: int = LEAF):
        self.y = y
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.rows: list[tuple[int, int]] = []
        #: rows in the order of the leaves, so that a leaf is one slice
        self.order = np.arange(len(y))
        self._grow(0, len(y), leaf)

    def _grow(self, start: int, stop: int, leaf: int) -> int:
        rows = self.order[start:stop]
        at, p = len(self.low), self.y[rows]
        self.low.append(p.min(axis=0))
        self.high.append(p.max(axis=0))
        self.kids.append(None)
        self.rows.append((start, stop))
        side = self.high[at] - self.low[at]
        if len(rows) > leaf and side.max() > 0:
            self.order[start:stop] = rows[np.argsort(p[:, side.argmax()], kind="stable")]
            half = (start + stop) // 2
            self.kids[at] = (self._grow(start, half, leaf), self._grow(half, stop, leaf))
        return at

    def gap(self, node: int, q: np.ndarray) -> float:
        """Squared distance of q to the box of a node."""
        d = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return float(d @ d)

    def nearest_first(self, q: np.ndarray):
        """(squared distance of the box, slice of ``order``) of leaves, nearest box first."""
        heap = [(self.gap(0, q), 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.kids[node] is None:
                yield d, self.rows[node]
            else:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (self.gap(kid, q), kid))


def search(tree: Tree, x: np.ndarray, q: np.ndarray, qy: np.ndarray, q_sq: float, big_sq: float, k: int, bound: float, chi: float, verified: list[int] | None = None):
    """Places in the tree's order of the k points with the largest inner product with q, verified in the order of
    the projected boxes. x: the vectors in the tree's order.

    bound: squared distance of the worst answer known from elsewhere (inf: none). verified: the points of each leaf that is
    looked at are added to it."""
    got = np.zeros(0, np.int64)
    dot = np.zeros(0)
    for d, (start, stop) in tree.nearest_first(qy):
        if d > chi * bound:
            break
        if verified is not None:
            verified.append(stop - start)
        new = x[start:stop] @ q
        if len(got) >= k:
            better = np.flatnonzero(new >= dot.min())
            if not len(better):
                continue
            got, dot = np.concatenate([got, better + start]), np.concatenate([dot, new[better]])
        else:
            got, dot = np.concatenate([got, np.arange(start, stop)]), np.concatenate([dot, new])
        if len(got) > k:
            best = np.argpartition(-dot, k - 1)[:k]
            # all that tie with the worst stay, so that ids can decide
            best = np.flatnonzero(dot >= dot[best].min())
            got, dot = got[best], dot[best]
        if len(got) >= k:
            bound = min(bound, big_sq + q_sq - 2 * dot.min())
    return got, dot


def _cells(sample: np.ndarray, n_cells: int) -> list:
    """Upper levels of the kd-tree: nested (axis, value, left, right), leaves are cell numbers."""
    count = iter(range(1 << 30))

    def grow(p, n):
        if n <= 1 or len(p) < 2 or (side := p.max(axis=0) - p.min(axis=0)).max() == 0:
            return next(count)
        axis = int(side.argmax())
        value = float(np.median(p[:, axis]))
        return [axis, value, grow(p[p[:, axis] < value], n // 2), grow(p[p[:, axis] >= value], n - n // 2)]

    return grow(sample, n_cells)


def _cell_of(tree, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(y), np.int64)
    todo = [(tree, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            out[rows] = node
        else:
            left = y[rows, node[0]] < node[1]
            todo += [(node[2], rows[left]), (node[3], rows[~left])]
    return out


def _bounded_cells(dealt: DataFrame, dims: int) -> tuple[DataFrame, pd.DataFrame]:
    """``dealt`` (v, ids, cell, y) with every cell split until it has at most CELL_ROWS rows, and the box of every cell."""
    for turn in range(60):
        size = dealt.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("y")[j]).alias(f"{name}{j}") for j in range(dims) for f, name in ((F.min, "lo"), (F.max, "hi"))])
        big = size.where(f"n > {CELL_ROWS}")
        if not big.limit(1).count():
            return dealt, size.toPandas()
        sides = ", ".join(f"hi{j} - lo{j}" for j in range(dims))
        big = big.selectExpr("cell AS big", f"CAST(least({PARTS}, ceil(2 * n / {CELL_ROWS}D)) AS INT) AS parts", f"CAST(array_position(array({sides}), array_max(array({sides}))) - 1 AS INT) AS axis")
        if turn < QUANTILE_ROUNDS:
            rows = dealt.join(big, F.col("cell") == F.col("big"))
            asked = ", ".join(f"{i / PARTS!r}D" for i in range(1, PARTS))
            cuts = rows.groupBy("big", "axis", "parts").agg(F.expr(f"percentile_approx(y[axis], array({asked}))").alias("cuts"))
            part = "CAST(size(filter(cuts, c -> c < y[axis])) * parts div 64 AS BIGINT)"
        else:
            cuts, part = big, "pmod(xxhash64(v), parts)"
        # cells that stay whole keep the first number of theirs
        dealt = written(dealt.join(cuts, F.col("cell") == F.col("big"), "left").selectExpr("v", "ids", f"cell * {PARTS} + coalesce({part}, 0L) AS cell", "y"), "op9-split")
    raise RuntimeError("cells could not be split")


def _gaps(y: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(first query, first box, squared distances) of blocks of queries and boxes."""
    for a in range(0, len(y), MEET_QUERIES):
        for c in range(0, len(lo), MEET_BOXES):
            gap = np.zeros((len(y[a:a + MEET_QUERIES]), len(lo[c:c + MEET_BOXES])))
            for j in range(y.shape[1]):
                side = y[a:a + MEET_QUERIES, j, None]
                gap += np.maximum(np.maximum(lo[None, c:c + MEET_BOXES, j] - side, side - hi[None, c:c + MEET_BOXES, j]), 0) ** 2
            yield a, c, gap


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k vectors of ``df`` (vec_id, embedding) with the largest
    inner product found, the query's own id left out. ``queries``: rows of the same form."""
    spark = importable(df.sparkSession)
    good = good_vectors(df)
    kept = k + 1  # one more, as a query may meet itself
    top = W.partitionBy("v").orderBy("vec_id")
    ids = good.select("vec_id", "v", "norm").distinct().withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= kept)
    points = written(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("norm").alias("norm")), "op9-points")
    stats = points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("big")).orderBy(F.desc("n"), "dim").first()
    if stats is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, big_sq = stats.dim, stats.n, stats.big ** 2
    project = np.random.default_rng(seed).normal(size=(dim + 1, dims))
    chi = chi_square_quantile(confidence, dims)
    n_cells = min(max(1, -(-n // CELL_ROWS)), max(1, SAMPLE // SAMPLE_PER_CELL))

    def projected(x):
        extra = np.sqrt(np.maximum(big_sq - (x * x).sum(axis=1), 0))
        return np.c_[x, extra] @ project

    sample = points.where(F.size("v") == dim).select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    cells = _cells(projected(_matrix(sample["v"], dim)), n_cells)

    def place(batches):
        for b in batches:
            if b.num_rows:
                y = projected(_matrix(b.column(0), dim))
                box = [pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), dims).cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_cell_of(cells, y)), *box], names=["v", "ids", "cell", "y"])

    dealt = written(points.where(F.size("v") == dim).select("v", "ids").mapInArrow(place, "v array<double>, ids array<long>, cell long, y array<double>"), "op9-cells")
    dealt, bounds = _bounded_cells(dealt, dims)
    cell_id = bounds["cell"].to_numpy()
    lo, hi = bounds[[f"lo{j}" for j in range(dims)]].to_numpy(), bounds[[f"hi{j}" for j in range(dims)]].to_numpy()

    # distinct query vectors, each with the ids that ask for it, under a written number; many ids of one vector are several searches
    q = good_vectors(queries).where(F.size("v") == dim).select("vec_id", "v").distinct()
    units = max(1, q.count() // UNIT_IDS)
    q = q.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(units))).agg(F.collect_list("vec_id").alias("query_ids"))
    q = written(q.select(F.monotonically_increasing_id().alias("qid"), "v", "query_ids"), "op9-queries")
    asked = q.select("qid", "v")

    def own(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                y = np.c_[x, np.zeros(len(x))] @ project
                least, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
                for a, c, gap in _gaps(y, lo, hi):
                    best = gap.argmin(axis=1)
                    rows = np.arange(a, a + len(gap))
                    closer = gap[rows - a, best] < least[rows]
                    rows, best = rows[closer], best[closer]
                    least[rows], at[rows] = gap[rows - a, best], best + c
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_id[at]), pa.array(np.full(len(x), np.inf))], names=["qid", "v", "cell", "bound"])

    def other(batches):
        for b in batches:
            if b.num_rows:
                x, own_cell, bound = _matrix(b.column(1), dim), b.column(2).to_numpy(), b.column(3).to_numpy()
                y = np.c_[x, np.zeros(len(x))] @ project
                for a, c, gap in _gaps(y, lo, hi):
                    rows = slice(a, a + len(gap))
                    i, box = np.nonzero((gap <= chi * bound[rows, None]) & (cell_id[None, c:c + gap.shape[1]] != own_cell[rows, None]))
                    i = i + a
                    for s in range(0, len(i), 10_000):
                        take = pa.array(i[s:s + 10_000])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell_id[box[s:s + 10_000] + c]), b.column(3).take(take)],
                                                         names=["qid", "v", "cell", "bound"])

    visit_schema = "qid long, v array<double>, cell long, bound double"
    answer_schema = "qid long, ids array<long>, score double, bound double, cell long"

    def visit(key, left, right):
        """All queries of a block against the points of a cell."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64()), "bound": pa.array([], pa.float64()), "cell": pa.array([], pa.int64())})
        tree = Tree(_matrix(right["y"], dims))
        x, right = _matrix(right["v"], dim)[tree.order], right.take(pa.array(tree.order))
        qx, qid, bound = _matrix(left["v"], dim), left["qid"].to_numpy(), left["bound"].to_numpy()
        qy = np.c_[qx, np.zeros(len(qx))] @ project
        at, dots, who, worst = [], [], [], []
        for i in range(len(qx)):
            q_sq = float(qx[i] @ qx[i])
            rows, dot = search(tree, x, qx[i], qy[i], q_sq, big_sq, kept, bound[i], chi)
            at.append(rows)
            dots.append(dot)
            who.append(np.full(len(rows), qid[i]))
            worst.append(np.full(len(rows), big_sq + q_sq - 2 * dot.min() if len(rows) >= kept else np.inf))
        at = np.concatenate(at)
        return pa.table({"qid": pa.array(np.concatenate(who)), "ids": right["ids"].take(pa.array(at)), "score": pa.array(np.concatenate(dots)),
                         "bound": pa.array(np.concatenate(worst)), "cell": right["cell"].take(pa.array(at))})

    def visited(visits):
        # a cell with many queries meets them in blocks: its points are dealt to each block
        load = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        a = visits.join(load, "cell").withColumn("block", F.pmod(F.col("qid"), F.col("blocks")).cast("int"))
        p = dealt.join(load, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return (a.select("qid", "v", "bound", "cell", "block").groupBy("cell", "block")
                .cogroup(p.select("ids", "v", "y", "cell", "block").groupBy("cell", "block")).applyInArrow(visit, answer_schema))

    first = written(visited(asked.mapInArrow(own, visit_schema)), "op9-first")
    worst = first.groupBy("qid").agg(F.max("bound").alias("bound"), F.first("cell").alias("cell"))
    more = visited(asked.join(worst, "qid").select("qid", "v", "cell", "bound").mapInArrow(other, visit_schema))
    found = first.select("qid", "ids", "score").unionAll(more.select("qid", "ids", "score"))
    best = W.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= kept).select("qid", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= kept).drop("_r")
    found = found.join(q.select(F.explode("query_ids").alias("query_id"), "qid"), "qid").where("query_id <> vec_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
