import datetime as dt
import os
import tempfile

import pytest

from pitchside import presets
from pitchside.operators.prompt import scouting_prompt
from pitchside.operators.summary import resolve_team, season_summary, team_summary
from pitchside.sources.readers import TEAM_MATCH_SCHEMA, read_team_matches

from conftest import rows

MEASURES = list(presets.TEAM_MEASURES)


def _row(date, team, base):
    vals = {m: (base if presets.TEAM_MEASURES[m] == "sum" else float(base) + 0.5) for m in MEASURES}
    vals["offsides"] = None
    vals["tot_duels_win_rate"] = None
    return (date, team, *[vals[m] for m in MEASURES])


def _matches(spark):
    schema = TEAM_MATCH_SCHEMA.fields[1:]
    ddl = "date timestamp, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    data = [_row(dt.datetime(2024, 3, 1), " Penn State Nittany Lions ", 2),
            _row(dt.datetime(2024, 4, 1), "Penn State Nittany Lions", 3),
            _row(dt.datetime(2023, 4, 1), "Penn State Nittany Lions", 100),
            _row(dt.datetime(2024, 5, 1), None, 7),
            _row(dt.datetime(2024, 2, 1), "Ohio State", 1)]
    return spark.createDataFrame(data, ddl)


def test_season_summary_fixture(spark):
    s = {r["team"]: r for r in season_summary(_matches(spark), year=2024).collect()}
    assert set(s) == {"Penn State Nittany Lions", "Ohio State"}       # stripped; NULL team dropped
    p = s["Penn State Nittany Lions"]
    assert p["goals"] == 5                                              # 2023 row ignored
    assert p["xg"] == pytest.approx(3.0)
    assert p["offsides"] == 0                                           # all-missing sum -> 0
    assert p["tot_duels_win_rate"] is None                              # all-missing mean -> NULL


def test_resolve_team(spark):
    m = _matches(spark)
    assert rows(resolve_team(m, "penn state", 2024)) == [("Penn State Nittany Lions",)]
    assert resolve_team(m, "xyz", 2024).count() == 0
    assert rows(resolve_team(m, "state", 2024)) == [("Ohio State",)]   # earliest date wins
    one = team_summary(m, "PENN", year=2024)
    assert [r["team"] for r in one.collect()] == ["Penn State Nittany Lions"]


def test_season_filter_reaches_the_scan(spark):
    path = tempfile.mkdtemp(prefix="pitchside-tm-")
    _matches(spark).write.mode("overwrite").parquet(path)
    plan = team_summary(spark.read.parquet(path), "penn", year=2024)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(date" in plan


def test_csv_reader(spark):
    d = tempfile.mkdtemp(prefix="pitchside-csv-")
    header = "date,team," + ",".join(MEASURES)
    line1 = "2024-09-01,Penn State Nittany Lions," + ",".join("1" for _ in MEASURES)
    line2 = "2024-09-08, Penn State Nittany Lions ," + ",".join("" if m == "xg" else "2" for m in MEASURES)
    with open(os.path.join(d, "teams.csv"), "w") as f:
        f.write("\n".join([header, line1, line2]) + "\n")
    s = season_summary(read_team_matches(spark, d), year=2024).collect()
    assert len(s) == 1 and s[0]["goals"] == 3 and s[0]["xg"] == pytest.approx(1.0)


# the whole prompt of Ohio State in the fixture (one match, base 1), with the lane and formation means below
EXPECTED_PROMPT = (
    "\n"
    "    Analyze the strengths and weaknesses of the opposing team based on the following statistics:\n"
    "\n"
    "    Team Stats:\n"
    "    \n"
    "    - Team: Ohio State\n"
    "    - Goals: 1\n"
    "    - Expected Goals (xG): 1.5\n"
    "    - Shots: 1\n"
    "    - Shots on Target (SOT): 1\n"
    "    - Pass Success Rate: 1.5%\n"
    "    - Possession: 1.5%\n"
    "    - Losses: 1\n"
    "    - Recoveries: 1\n"
    "    - Total Duels: 1\n"
    "    - Corners: 1\n"
    "    - Fouls: 1\n"
    "    - Yellow Cards: 1\n"
    "    - Red Cards: 1\n"
    "    - Shots Against: 1\n"
    "    - Goals Against: 1\n"
    "    - Defensive Duels: 1\n"
    "    - Interceptions: 1\n"
    "    - Clearances: 1\n"
    "    - Offsides: 0\n"
    "    \n"
    "\n"
    "    Attack Side Breakdown:\n"
    "    \n"
    "    Attack Side Breakdown:\n"
    "    - Left Side: 3.5 attempts, xG: 0.2\n"
    "    - Middle: 5.5 attempts, xG: 1e-05\n"
    "    - Right Side: 6.0 attempts, xG: 12345678.9\n"
    "    \n"
    "\n"
    "    Average Formation Possession:\n"
    "    \n"
    "    Average Formation Possession by Time Period:\n"
    "    - Total: 45.5%\n"
    "    \n"
    "\n"
    "    Provide insights on the team's weaknesses and strategies for exploiting them.\n"
    "    "
)


def test_prompt_text_matches_python_formatting(spark):
    summary = season_summary(_matches(spark), year=2024).filter("team = 'Ohio State'")
    lane_vals = {"left_attempts": 3.5, "left_XG": 0.2, "mid_attempts": 5.5, "mid_XG": 1e-05,
                 "right_attempts": 6.0, "right_XG": 12345678.9}
    lanes = spark.createDataFrame([("Ohio State", *lane_vals.values())],
                                  "team string, " + ", ".join(f"{k} double" for k in lane_vals))
    form = spark.createDataFrame([("Ohio State", 45.5)], "team string, Total double")
    got = scouting_prompt(summary, lanes, form).collect()[0]
    assert got["prompt"] == EXPECTED_PROMPT
    assert got["system_message"] == presets.SYSTEM_MESSAGE
