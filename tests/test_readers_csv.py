"""CSV readers: columns by name, safe casts, date formats, reject counts."""
import os
import tempfile

import pytest

from pitchside import presets
from pitchside.operators.summary import season_summary
from pitchside.sources.readers import TEAM_MATCH_SCHEMA, csv_rejects, read_player_matches, read_team_matches

MEASURES = list(presets.TEAM_MEASURES)
SUMS = [m for m, how in presets.TEAM_MEASURES.items() if how == "sum"]


def _file(lines):
    d = tempfile.mkdtemp(prefix="pitchside-csv-")
    with open(os.path.join(d, "teams.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def _line(cols, date, **cells):
    values = {"date": date, "team": "T", "extra": "B1G", **dict.fromkeys(MEASURES, "1"), **cells}
    return ",".join('"%s"' % values[c] if "," in values[c] else values[c] for c in cols)


def test_extra_and_reordered_columns_and_float_counts(spark):
    cols = [*MEASURES[::-1], "extra", "team", "date"]
    goal = SUMS[0]
    d = _file([",".join(cols), _line(cols, "2024-09-01", **{goal: "3.0"}), _line(cols, "09/08/2024", **{goal: " 2 "}),
               _line(cols, "Sep 15, 2024", **{goal: ""}), _line(cols, "someday", **{goal: "7"}),
               _line(cols, "2024-10-01", **{goal: "2.5"})])
    got = read_team_matches(spark, d)
    assert got.columns == TEAM_MATCH_SCHEMA.names
    dates = sorted(str(r["date"])[:10] for r in got.collect())
    assert dates == ["2024-09-01", "2024-09-08", "2024-09-15", "2024-10-01", "None"]
    s = season_summary(got, year=2024).collect()
    assert len(s) == 1 and s[0]["team"] == "T" and s[0][goal] == 5
    bad = {r["column"]: r["rejected"] for r in csv_rejects(spark, d, TEAM_MATCH_SCHEMA, date_col="date").collect()}
    assert bad["date"] == 1 and bad[goal] == 1 and sum(bad.values()) == 2


def test_missing_column_raises_with_its_name(spark):
    cols = ["date", "team", *MEASURES[1:]]
    with pytest.raises(ValueError, match=f"no column {MEASURES[0]}"):
        read_team_matches(spark, _file([",".join(cols), _line(cols, "2024-09-01")]))
    with pytest.raises(ValueError, match="Minutes played"):
        read_player_matches(spark, _file(["year,player_name,team,Position", "2024,a,b,CB"]))


def test_files_with_another_header_fail_instead_of_mixing(spark):
    cols = ["date", "team", *MEASURES]
    other = ["team", "date", *MEASURES]
    d = _file([",".join(cols), _line(cols, "2024-09-01")])
    with open(os.path.join(d, "zz.csv"), "w") as f:
        f.write("\n".join([",".join(other), _line(other, "2024-09-02")]) + "\n")
    with pytest.raises(Exception, match="header"):
        read_team_matches(spark, d).collect()
