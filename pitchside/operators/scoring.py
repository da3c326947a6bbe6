"""Weighted per-90 scores, league percentiles, top-k per aspect.

Plan shape: one scan, one projection that computes all weighted terms (whole-
stage codegen), one hash aggregate per (player, team) with map-side partial
aggregation, then the percentile rank (``avg_pct_rank``) and a windowed
top-k that Spark turns into a ``WindowGroupLimit`` before the shuffle.
Expressions are handed to Spark as SQL text (one call per statement).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.exact import exact_means
from pitchside.functions.numeric import nan_to_null_sql, per90_term_sql, skipna_sum_sql
from pitchside.functions.sql import dbl, lit_str, project, q, run_sql
from pitchside.session import ensure_checkpoint_dir


def score_col(aspect: str) -> str:
    return f"{aspect}_total_weighted_score"


def pct_col(aspect: str) -> str:
    return f"{aspect}_percentile"


def season_filter(df: DataFrame, season: int | None, season_col: str = "year") -> DataFrame:
    """Keep one season; applied before anything else so percentiles are per season."""
    if season is None:
        return df
    return df.filter(f"{q(season_col)} = {int(season)}")


def match_scores_sql(weights: Mapping[str, Mapping[str, float]], minutes: str) -> list[tuple[str, str]]:
    """Per-match aspect totals ``sum_m coalesce(m / minutes * 90 * w, 0)``."""
    return [(score_col(a), skipna_sum_sql([per90_term_sql(q(m), q(minutes), w) for m, w in ws.items()]))
            for a, ws in weights.items()]


def weighted_scores(matches: DataFrame, weights: Mapping[str, Mapping[str, float]] = presets.WEIGHTS,
                    keys: Sequence[str] = ("player_name", "team"),
                    minutes: str = presets.MINUTES_COL) -> DataFrame:
    """Mean per ``keys`` of the per-match aspect totals.

    The mean does not depend on the order of the rows (``functions.exact``), so players
    with equal matches are tied on every run. It is of per-match ratios (not a ratio of sums); one over both
    infinities has no value and is NULL (N14). Rows whose key is
    NULL are dropped, as ``groupby`` does (N4).
    """
    not_null = " AND ".join(f"{q(c)} IS NOT NULL" for c in keys)
    means = exact_means(matches, keys, match_scores_sql(weights, minutes), not_null)
    return project(means, [(n, nan_to_null_sql(q(n))) for n in map(score_col, weights)], keep=keys)


# --------------------------------------------------------------------------
# Average percent rank  (rank of ties averaged) / (non-null count)
# --------------------------------------------------------------------------

#: KLL parameter of the quantile sketches: rank errors of about 0.1 %, so more buckets than ``MAX_BUCKETS`` could not be told apart.
SKETCH_K, MAX_BUCKETS = 4096, 1024
#: Split points of the coarse level of the bucket lookup.
_COARSE = 32


def rank_buckets(df: DataFrame) -> int:
    """Buckets of the ranking: four per shuffle partition, 64 at least, as many as the sketch can tell apart at most."""
    return min(MAX_BUCKETS, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def value_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., column, sketch``: a mergeable quantile sketch (binary) of every column, e.g. per season; NULL, NaN and
    infinities are left out. Written per season, such tables are merged by ``merged_bounds`` without reading the scores again."""
    g = "".join(f"{q(b)}, " for b in by)
    aggs = ", ".join(f"kll_sketch_agg_double(CASE WHEN abs({nan_to_null_sql(q(c))}) < {dbl(float('inf'))} THEN CAST({q(c)} AS DOUBLE) END, {SKETCH_K}) AS __s{i}" for i, c in enumerate(cols))
    stack = ", ".join(f"{lit_str(c)}, __s{i}" for i, c in enumerate(cols))
    group = f"GROUP BY {g.rstrip(', ')}" if by else ""
    return run_sql({"src": df}, f"SELECT {g}stack({len(cols)}, {stack}) AS (column, sketch) FROM (SELECT {g}{aggs} FROM {{src}} {group})")


def merged_bounds(sketches: DataFrame, buckets: int) -> DataFrame:
    """``column, coarse, fine``: increasing split points of up to ``buckets`` buckets for every column, from all of its sketches; ``fine``
    holds the split points between two coarse ones. One row per column with at most ``MAX_BUCKETS`` numbers."""
    buckets = max(2, min(buckets, MAX_BUCKETS))
    asked = ", ".join(dbl(i / buckets) for i in range(1, buckets))
    steps = [("m", "SELECT column, kll_merge_agg_double(sketch) AS s FROM {sk} WHERE kll_sketch_get_n_double(sketch) > 0 GROUP BY column"),
             ("b", f"SELECT column, array_sort(array_distinct(kll_sketch_get_quantile_double(s, array({asked})))) AS b FROM {{m}}"),
             ("w", f"SELECT column, b, CAST(ceil(size(b) / {_COARSE}D) AS INT) AS width FROM {{b}}")]
    return run_sql({"sk": sketches}, """SELECT column, transform(sequence(1, CAST(ceil(size(b) / width) AS INT)), i -> b[least(i * width, size(b)) - 1]) AS coarse,
       transform(sequence(1, CAST(ceil(size(b) / width) AS INT)), i -> slice(b, (i - 1) * width + 1, width)) AS fine FROM {w}""", steps)


def _bucket_sql(v: str, bounds: str) -> str:
    """The number of split points below ``v``: a count among the coarse ones, then one among the fine ones behind them, so the work grows
    with the root of the buckets. ``bounds`` is a struct (coarse, fine)."""
    above = f"size(filter({bounds}.coarse, b -> b < {v}))"
    return (f"CASE WHEN {bounds} IS NULL THEN 0 WHEN {above} >= size({bounds}.coarse) THEN {above} * 1000 "
            f"ELSE {above} * 1000 + size(filter({bounds}.fine[{above}], b -> b < {v})) END")


def value_ranks(df: DataFrame, values: Sequence[str], bounds: DataFrame) -> DataFrame:
    """``i, v, p``: the average percent rank of every distinct value ``v`` of column number ``i`` of ``values``, all columns in one pass.

    ``bounds`` has one row per column with at most ``MAX_BUCKETS`` numbers, the offsets have as many rows per column: both are broadcast."""
    stack = ", ".join(f"{i}, {nan_to_null_sql(q(c))}" for i, c in enumerate(values))
    number = " ".join(f"WHEN {lit_str(c)} THEN {i}" for i, c in enumerate(values))
    steps = [
        ("b", f"SELECT CASE column {number} END AS i, struct(coarse, fine) AS s FROM {{bounds}}"),
        ("d", f"SELECT i, v, count(*) AS cnt FROM (SELECT stack({len(values)}, {stack}) AS (i, v) FROM {{src}}) WHERE v IS NOT NULL GROUP BY i, v"),
        ("h", f"SELECT /*+ BROADCAST(b) */ d.i, v, cnt, {_bucket_sql('v', 'b.s')} AS bk FROM {{d}} d LEFT JOIN {{b}} b ON d.i = b.i"),
        ("c", "SELECT i, v, cnt, bk, sum(cnt) OVER (PARTITION BY i, bk ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM {h}"),
        ("o", """SELECT i, bk, coalesce(sum(bk_cnt) OVER (PARTITION BY i ORDER BY bk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
       sum(bk_cnt) OVER (PARTITION BY i) AS n FROM (SELECT i, bk, sum(cnt) AS bk_cnt FROM {h} GROUP BY i, bk)"""),
    ]
    return run_sql({"src": df, "bounds": bounds}, """SELECT /*+ BROADCAST(o) */ c.i, c.v, CAST((off + cum - cnt + (cnt + 1) / 2.0D) / n AS DOUBLE) AS p
FROM {c} c JOIN {o} o ON c.i = o.i AND c.bk = o.bk""", steps)


def avg_pct_ranks(df: DataFrame, values: Mapping[str, str], method: str = "scale",
                  buckets: int | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """``Series.rank(pct=True)`` over the whole frame for several columns:
    ``values`` maps input column -> output column.

    ``p(v) = (#{x < v} + (#{x == v} + 1) / 2) / #{x not null}``; NULL/NaN stay
    NULL, +-inf are ordinary extremes (N6).

    ``method="scale"`` never puts all rows into one task: the distinct values of all columns are
    counted with a partial aggregate, bucketed by the split points of a quantile
    sketch, prefix-summed inside each bucket (a window partitioned by
    bucket), and offset by the totals of the earlier buckets. The split points (``bounds``,
    default: sketched from ``df``) and the ranks of the distinct values are tables in the
    checkpoint folder; the result does not depend on the split points.
    ``method="window"`` is the textbook unpartitioned window (test oracle).
    """
    cols = list(df.columns)
    src_cols = ", ".join(q(c) for c in cols)
    if method == "window":
        outs = []
        for value, out in values.items():
            v = nan_to_null_sql(q(value))
            outs.append(f"CASE WHEN {v} IS NULL THEN NULL ELSE CAST((rank() OVER (ORDER BY {v} NULLS LAST) "
                        f"+ (count(*) OVER (PARTITION BY {v}) - 1) / 2.0D) / count({v}) OVER () AS DOUBLE) END "
                        f"AS {q(out)}")
        return run_sql({"src": df}, f"SELECT {src_cols}, {', '.join(outs)} FROM {{src}}")
    if method != "scale":
        raise ValueError("method must be 'scale' or 'window'")
    if bounds is None:
        bounds = merged_bounds(value_sketches(df, list(values)), rank_buckets(df) if buckets is None else buckets)
    # a sketch made again after a lost executor could differ: the split points are fixed before they are used
    ensure_checkpoint_dir(df.sparkSession)
    bounds = bounds.checkpoint(eager=True)
    ranks = value_ranks(df, list(values), bounds).checkpoint(eager=True)
    keyed = ", ".join(f"{nan_to_null_sql(q(value))} AS __k{i}" for i, value in enumerate(values))
    sel = ", ".join(f"r{i}.p AS {q(out)}" for i, out in enumerate(values.values()))
    joins = " ".join(f"LEFT JOIN (SELECT v, p FROM {{r}} WHERE i = {i}) r{i} ON s.__k{i} = r{i}.v" for i in range(len(values)))
    s_cols = ", ".join(f"s.{q(c)}" for c in cols)
    return run_sql({"src": df, "r": ranks}, f"SELECT {s_cols}, {sel} FROM {{s}} s {joins}", [("s", f"SELECT {src_cols}, {keyed} FROM {{src}}")])


def avg_pct_rank(df: DataFrame, value: str, out: str, method: str = "scale", buckets: int | None = None,
                 bounds: DataFrame | None = None) -> DataFrame:
    """Single-column form of ``avg_pct_ranks``."""
    return avg_pct_ranks(df, {value: out}, method, buckets, bounds)


def league_percentiles(scores: DataFrame, aspects: Sequence[str] = presets.ASPECTS,
                       method: str = "scale", materialize: bool = True) -> DataFrame:
    """P6 for every aspect score, over all teams (before any team filter).

    ``materialize`` checkpoints the (small, one row per player and team)
    score table into the session's checkpoint folder first, so the boundary
    pass and the ranking read it instead of re-aggregating the match rows.
    """
    if materialize:
        ensure_checkpoint_dir(scores.sparkSession)
        scores = scores.checkpoint(eager=True)
    return avg_pct_ranks(scores, {score_col(a): pct_col(a) for a in aspects}, method)


# --------------------------------------------------------------------------
# Top-k per aspect
# --------------------------------------------------------------------------

def top_k_by_aspect(scored: DataFrame, k: int, aspects: Sequence[str] = presets.ASPECTS,
                    team_col: str = "team", name_col: str = "player_name",
                    teams: Sequence[str] | None = None, k_of: Mapping[str, int] | None = None) -> DataFrame:
    """Top ``k`` rows per (team, aspect), tagged ``aspect``, ``aspect_order``
    and ``aspect_rank``.

    The reference does one team; this does every team at once (or ``teams``);
    ``k_of`` names teams that get another number of rows than ``k``.
    Order: score descending with missing scores last, then player name (N9).
    The team filter sits above the percentile, which Catalyst keeps (P7).
    """
    cols = ", ".join(q(c) for c in scored.columns)
    stack = ", ".join(f"{lit_str(a)}, {i}, {nan_to_null_sql(q(score_col(a)))}" for i, a in enumerate(aspects))
    where = ""
    if teams is not None:
        where = f"WHERE {q(team_col)} IN ({', '.join(lit_str(t) for t in teams)})"
    each = ""  # the constant above lets Spark limit the groups before the shuffle
    if k_of:
        cases = " ".join(f"WHEN {lit_str(t)} THEN {int(n)}" for t, n in k_of.items())
        each = f" AND aspect_rank <= CASE {q(team_col)} {cases} ELSE {int(k)} END"
    sql = f"""SELECT {cols}, aspect, aspect_order, aspect_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {q(team_col)}, aspect
                                    ORDER BY __score DESC NULLS LAST, {q(name_col)} ASC) AS BIGINT) AS aspect_rank
  FROM (SELECT {cols}, stack({len(aspects)}, {stack}) AS (aspect, aspect_order, __score) FROM {{src}} {where}))
WHERE aspect_rank <= {max([k, *(k_of or {}).values()])}{each}"""
    return run_sql({"src": scored}, sql)


def crucial_players(matches: DataFrame, k: int, teams: Sequence[str] | None = None,
                    season: int | None = None, season_col: str = "year",
                    weights: Mapping[str, Mapping[str, float]] = presets.WEIGHTS,
                    keys: Sequence[str] = ("player_name", "team"),
                    minutes: str = presets.MINUTES_COL, method: str = "scale") -> DataFrame:
    """P1-P9 composed: the reference's ``calculate_weighted_scores`` for many teams."""
    scores = weighted_scores(season_filter(matches, season, season_col), weights, keys, minutes)
    scored = league_percentiles(scores, list(weights), method=method)
    return top_k_by_aspect(scored, k, list(weights), team_col=keys[1], name_col=keys[0], teams=teams)
