import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchside import presets
from pitchside.operators.scoring import (
    avg_pct_rank, league_percentiles, merged_bounds, top_k_by_aspect, value_ranks, value_sketches, weighted_scores,
)

METRICS = [m for ws in presets.WEIGHTS.values() for m in ws]
SCHEMA = ("player_name string, team string, `Minutes played` double, "
          + ", ".join(f"{m} double" for m in METRICS))


def _match(player, team, minutes, goals=0.0, assists=0.0, xg=0.0):
    vals = {m: 0.0 for m in METRICS}
    vals.update(goals=goals, assists=assists, xg=xg)
    return (player, team, minutes, *[vals[m] for m in METRICS])


FIXTURE = [
    _match("A", "T1", 90.0, goals=1.0),
    _match("A", "T1", 45.0, xg=0.5),
    _match("B", "T1", 0.0),
    _match("B", "T1", 90.0, goals=1.0),
    _match("C", "T2", 0.0, goals=1.0),
    _match("D", "T2", 90.0, assists=1.0),
    _match("E", "T2", 90.0, goals=None, assists=1.0),
]


@pytest.fixture(scope="module")
def matches(spark):
    return spark.createDataFrame(FIXTURE + [_match("Z", None, 90.0, goals=5.0)], SCHEMA)


def test_per90_scores_follow_pandas_rules(matches):
    s = {r["player_name"]: r["attacking_total_weighted_score"]
         for r in weighted_scores(matches).collect()}
    assert s["A"] == pytest.approx(1.75)
    assert s["B"] == pytest.approx(1.0)      # 0-minute all-zero match counts as 0 (N2)
    assert s["C"] == math.inf                # x/0 -> inf under ANSI (N1)
    assert s["D"] == pytest.approx(1.8)
    assert s["E"] == pytest.approx(1.8)      # NULL goals skipped
    assert "Z" not in s                      # NULL team dropped (N4)


@pytest.mark.parametrize("method", ["scale", "window"])
def test_average_percent_rank(matches, method):
    scored = league_percentiles(weighted_scores(matches), ["attacking"], method=method)
    p = {r["player_name"]: r["attacking_percentile"] for r in scored.collect()}
    assert p == pytest.approx({"A": 0.4, "B": 0.2, "C": 1.0, "D": 0.7, "E": 0.7})


def test_top_k_per_team_and_aspect(matches):
    scored = league_percentiles(weighted_scores(matches))
    top = top_k_by_aspect(scored, 1).filter(F.col("aspect") == "attacking")
    assert {r["team"]: r["player_name"] for r in top.collect()} == {"T1": "A", "T2": "C"}
    assert top.schema["aspect_rank"].dataType.simpleString() == "bigint"


def test_top_k_ties_break_on_name(spark):
    df = spark.createDataFrame([("b", "T", 1.0), ("a", "T", 1.0), ("c", "T", None)],
                               "player_name string, team string, attacking_total_weighted_score double")
    top = top_k_by_aspect(df, 3, ["attacking"]).orderBy("aspect_rank")
    assert [r["player_name"] for r in top.collect()] == ["a", "b", "c"]   # missing score last


def test_scale_form_equals_pandas_rank_on_random_values(spark):
    rnd = random.Random(7)
    pool = [rnd.choice([0.0, 1.0, 2.5]) for _ in range(50)] + [rnd.uniform(-5, 5) for _ in range(300)]
    pool += [math.inf, -math.inf, math.inf, None, None]
    rnd.shuffle(pool)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(pool)], "id int, v double")
    expect = pd.Series([math.nan if v is None else v for v in pool]).rank(pct=True)
    for buckets in (1, 3, 16):
        got = {r["id"]: r["p"] for r in avg_pct_rank(df, "v", "p", buckets=buckets).collect()}
        for i, e in enumerate(expect):
            if math.isnan(e):
                assert got[i] is None
            else:
                assert got[i] == pytest.approx(e, abs=1e-12)


def test_scale_form_has_no_global_window_over_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 37).cast("double").alias("v"))
    plan = value_ranks(df, ["v"], merged_bounds(value_sketches(df, ["v"]), 64))._jdf.queryExecution().executedPlan().toString()
    # distinct values are ranked inside hash partitions of (column, bucket); only the buckets' totals share a partition per column
    assert "hashpartitioning(i#" in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("[i#" in w for w in windows)


def test_bounds_are_no_literals_and_merge_over_seasons(spark):
    rnd = random.Random(3)
    rows = [(1990 + i % 4, rnd.choice([rnd.uniform(-3, 3), float(rnd.randrange(4)), math.inf, math.nan])) for i in range(4000)]
    df = spark.createDataFrame(rows, "season int, v double")
    bounds = merged_bounds(value_sketches(df, ["v"], by=["season"]), 64)
    row = bounds.first()
    flat = [x for part in row.fine for x in part]
    assert row.column == "v" and flat == sorted(set(flat)) and 30 <= len(flat) <= 63 and row.coarse == [part[-1] for part in row.fine]
    got = avg_pct_rank(df, "v", "p", bounds=bounds)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(repr(x)[:8] in plan for x in flat if abs(x) > 1e-3 and x != int(x))
    want = avg_pct_rank(df, "v", "p", method="window")
    key = lambda r: (r.season, repr(r.v), r.p)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_buckets_follow_the_bounds(spark):
    df = spark.range(20_000).selectExpr("CAST(id * 7919 % 20011 AS DOUBLE) / 8 AS v")
    for buckets in (2, 33, 1000):
        b = merged_bounds(value_sketches(df, ["v"]), buckets)
        flat = [x for part in b.first().fine for x in part]
        got = avg_pct_rank(df, "v", "p", bounds=b)
        assert [r.p for r in got.orderBy("v").collect()] == [(i + 1) / 20_000 for i in range(20_000)]
        assert len(flat) == buckets - 1


def test_values_without_a_finite_one(spark):
    for values in ([math.inf, -math.inf, math.inf], [None], [math.nan, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got, want = (sorted(repr((r.v, r.p)) for r in avg_pct_rank(df, "v", "p", method=m).collect()) for m in ("scale", "window"))
        assert got == want
    assert avg_pct_rank(spark.createDataFrame([], "v double"), "v", "p").count() == 0


def test_top_k_plan_limits_groups_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("concat('p', id) AS player_name", "concat('T', id % 7) AS team",
                                      "CAST(id % 97 AS DOUBLE) AS attacking_total_weighted_score")
    plan = top_k_by_aspect(df, 3, ["attacking"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
