import pytest
from pyspark.sql import functions as F

from pitchside import presets
from pitchside.operators.matchup import counter_matchups, pitch_layout, with_percentiles
from pitchside.operators.positions import primary_category

from conftest import rows

POS_SCHEMA = "player_name string, team string, Position string, `Minutes played` double"


def test_primary_position_fixture(spark):
    df = spark.createDataFrame([
        ("A", "T", "LCB, CB", 90.0), ("A", "T", "CB", 45.0), ("A", "T", "0", 60.0),
        ("B", "T", "RW, LW", 90.0), ("C", "T", "SS", 90.0), ("D", "T", None, 90.0),
        ("E", "T", "0", 90.0), ("F", "T", "LCB", 60.0), ("F", "T", "RCB", 50.0), ("F", "T", "AMF", 80.0),
    ], POS_SCHEMA)
    got = dict((r[0], r[2]) for r in rows(primary_category(df)))
    # raw codes compete (F: AMF 80 beats LCB 60 / RCB 50 although CB = 110);
    # ties go to the first code (B); unmapped -> NULL (C); NULL list stays (D);
    # only-sentinel players vanish (E)
    assert got == {"A": "CB", "B": "LW", "C": None, "D": None, "F": "AMF"}


def test_primary_position_raw_code_without_map(spark):
    df = spark.createDataFrame([("C", "T", "SS", 90.0)], POS_SCHEMA)
    assert rows(primary_category(df, mapping={"SS": "SS"})) == [("C", "T", "SS")]


SCORES = [presets.ASPECTS[0], presets.ASPECTS[1], presets.ASPECTS[2]]
COLS = ("player_name string, team string, Most_played_position string, aspect string, aspect_rank long, "
        "aspect_order int, defensive_total_weighted_score double, attacking_total_weighted_score double, "
        "passing_total_weighted_score double, defensive_percentile double, attacking_percentile double, "
        "passing_percentile double")


@pytest.fixture(scope="module")
def pools(spark):
    rivals = spark.createDataFrame([
        ("R1", "X", "CF", "attacking", 1, 1, 0.0, 9.0, 0.0, 0.1, 0.9, 0.2),
        ("R2", "X", "CB", "defensive", 1, 0, 8.0, 0.0, 0.0, 0.8, 0.1, 0.3),
        ("R3", "X", None, "passing", 1, 2, 0.0, 0.0, 7.0, 0.2, 0.2, 0.95),
        ("R1", "X", "CF", "passing", 2, 2, 0.0, 9.0, 0.0, 0.1, 0.9, 0.2),
    ], COLS)
    own = spark.createDataFrame([
        ("O1", "N", "CB", "defensive", 1, 0, 5.0, 0.5, 2.0, 0.5, 0.3, 0.4),
        ("O2", "N", "CB", "defensive", 2, 0, 5.0, 1.0, 9.0, 0.5, 0.4, 0.9),
        ("O2", "N", "CB", "passing", 1, 2, 5.0, 1.0, 9.0, 0.5, 0.4, 0.9),
        ("O3", "N", "CF", "attacking", 1, 1, 0.0, 7.0, 0.0, 0.1, 0.8, 0.1),
    ], COLS)
    return rivals, own


def test_counter_matchups_fixture(pools):
    rivals, own = pools
    m = with_percentiles(counter_matchups(rivals, own), rivals, own)
    got = rows(m, "rival_name", "aspect", "own_name", "own_position")
    assert got == sorted([("R1", "attacking", "O1", "CB"),    # tie on defensive 5 -> name order
                          ("R1", "passing", "O2", "CB"),
                          ("R2", "defensive", "O3", "CF"),
                          ("R3", "passing", None, None)], key=repr)   # reference raises here
    assert m.count() == 4                                            # no fan-out


def test_pitch_layout_fixture(pools):
    rivals, own = pools
    layout = pitch_layout(with_percentiles(counter_matchups(rivals, own), rivals, own))
    got = {r["own_position"]: r for r in layout.collect()}
    assert set(got) == {"CB", "CF"}
    cb, cf = got["CB"], got["CF"]
    assert (cb["own_name"], cb["rival_name"]) == ("O1", "R1")        # attacking row comes first
    assert (cb["own_x"], cb["own_y"], cb["rival_x"], cb["rival_y"]) == (40, 25, 40, 30)
    assert (cf["own_name"], cf["own_x"], cf["own_y"], cf["rival_y"]) == ("O3", 40, 100, 105)
    assert cb["own_label"] == "P: 40.0%\nA: 30.0%\nD: 50.0%"
    assert cf["rival_label"] == "P: 30.0%\nA: 10.0%\nD: 80.0%"


def test_counter_lookup_is_broadcast(pools):
    rivals, own = pools
    plan = counter_matchups(rivals, own)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert F is not None
