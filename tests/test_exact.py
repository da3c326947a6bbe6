import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pitchside import presets
from pitchside.functions.exact import LOW, exact_means, fixed_sql
from pitchside.functions.text import py_fixed_sql
from pitchside.operators.scoring import league_percentiles, pct_col, score_col, weighted_scores
from pitchside.plans import standins as si

SF = "/root/testdata/sf0.001"


def _values(seed, n):
    r = random.Random(seed)
    return [r.choice([r.uniform(-1, 1) * 10 ** r.randrange(-6, 7), 0.1, -0.1, 1e9 + 0.3, -1e9, 2.0 ** -80, 0.0]) for _ in range(n)]


def test_means_equal_exact_fractions_and_ignore_order(spark):
    rows = [(i % 13, x) for i, x in enumerate(_values(1, 6000))] + [(99, None), (98, 1e16), (98, 1.0), (98, -1e16), (97, -0.5), (97, -2.0 ** -60)]
    r = random.Random(2)
    seen = []
    for parts in (1, 7, 64):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, x double").repartition(parts)
        got = {row.k: row.m for row in exact_means(df, ["k"], [("m", "x")]).collect()}
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]  # bit for bit
    for k, m in seen[0].items():
        xs = [x for kk, x in rows if kk == k and x is not None]
        if not xs:
            assert m is None
            continue
        want = sum(map(Fraction, xs)) / len(xs)
        assert abs(Fraction(m) - want) <= abs(want) * Fraction(1, 2 ** 50) + Fraction(2) ** LOW


def test_infinities_follow_ieee(spark):
    inf = float("inf")
    rows = [(1, inf), (1, 2.0), (2, -inf), (3, inf), (3, -inf), (4, 1e300), (4, 1.0), (5, float("nan")), (5, 1.0)]
    got = {r.k: r.m for r in exact_means(spark.createDataFrame(rows, "k int, x double"), ["k"], [("m", "x")]).collect()}
    assert got[1] == inf and got[2] == -inf and math.isnan(got[3]) and got[4] == 5e299 and math.isnan(got[5])


def test_scores_and_ranks_do_not_depend_on_the_partitions(spark):
    rows = si.player_matches(spark, SF)
    keys, cols = ["player_name", "team"], [*map(score_col, presets.ASPECTS), *map(pct_col, presets.ASPECTS)]
    seen = []
    for parts in (1, 5, 23):
        shuffled = rows.orderBy(F.xxhash64("player_name", F.lit(parts), "`Minutes played`", "crosses")).repartition(parts)
        got = league_percentiles(weighted_scores(shuffled)).select(*keys, *cols).collect()
        seen.append({(r.player_name, r.team): tuple(r)[2:] for r in got})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 10


def test_players_with_equal_matches_stay_tied(spark):
    r = random.Random(4)
    cols = si.player_matches(spark, SF).columns
    base = si.player_matches(spark, SF).limit(60).toPandas()
    rows = []
    for p in range(40):
        for _, m in base.sample(frac=1, random_state=p).iterrows():
            rows.append(tuple(f"p{p}" if c == "player_name" else "t" if c == "team" else m[c] for c in cols))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, si.player_matches(spark, SF).schema).repartition(11)
    scores = weighted_scores(df).collect()
    assert len(scores) == 40 and all(len({s[score_col(a)] for s in scores}) == 1 for a in presets.ASPECTS)


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_labels_equal_pythons_format(spark, digits):
    r = random.Random(digits)
    xs = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 2.675, 1.005, 0.125, 0.375, -0.04, 99.95, 0.05, 1e-300, 5e-324, 2.0 ** 49 + 0.25, 2.0 ** 50 + 0.25, 2.0 ** 51 + 0.5, 2.0 ** 52 + 1, 1e15 + 0.5,
          0.045, 8.345, 1e-17, 0.5 - 2 ** -54, 0.5 + 2 ** -53, 0.25 + 2 ** -60]
    xs += [r.uniform(-1, 1) * 10 ** r.randrange(-12, 19) for _ in range(20_000)]
    xs += [r.randrange(-10 ** 7, 10 ** 7) / 8 for _ in range(2_500)] + [(2 * r.randrange(10 ** 6) + 1) / 2 / 10 ** digits for _ in range(2_500)]
    xs += [r.randrange(2 ** 49, 2 ** 53) + r.choice([0.25, 0.5, 0.75, 0.125]) for _ in range(1_000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for sql in (fixed_sql("x", digits), py_fixed_sql("x", digits)):
        bad = [(row.x, row.s, f"{row.x:.{digits}f}") for row in df.selectExpr("x", f"{sql} AS s").collect() if row.s != f"{row.x:.{digits}f}"]
        assert not bad, bad[:5]
    odd = df.limit(1).selectExpr(*[f"{py_fixed_sql(v, digits)} AS `{i}`" for i, v in enumerate(["CAST(NULL AS DOUBLE)", "double('NaN')", "double('Infinity')", "double('-Infinity')"])])
    assert tuple(odd.first()) == ("nan", "nan", "inf", "-inf")
