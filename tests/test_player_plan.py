import __spark_entry__ as E
from pitchside.plans import standins as si
from pitchside.plans.player import player_matchups

from conftest import rows

SF = "/root/testdata/sf0.001"


def test_player_job_equals_registered_queries(spark):
    res = player_matchups(si.player_matches(spark, SF), None, si.STANDIN_OWN_TEAM, season=si.STANDIN_SEASON,
                          position_map=si.STANDIN_POSITION_MAP)
    cols = ("own_position", "own_name", "rival_name", "own_label", "rival_label")
    assert rows(res.pitch, *cols) == rows(E.queries()["pitch_layout"](spark, SF), *cols)
    m_cols = ("rival_name", "rival_team", "aspect", "own_name", "own_position")
    assert rows(res.matchups, *m_cols) == rows(E.queries()["counter_matchups"](spark, SF), *m_cols)
