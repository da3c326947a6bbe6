"""Player job: scores -> crucial players -> positions -> matchups -> pitch.

Scores and positions are computed once for every team of the season (the reference
runs the whole scoring twice, once per team) and checkpointed together: that table has
one row per (player, team), tiny next to the match rows, and every later step
(percentiles, both top-k lists, matchups) reads it instead of
re-aggregating the matches. Over a table written by ``sinks.write_player_table``
nothing is shuffled on (player, team): its buckets already hold each player whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.sql import lit_str, q
from pitchside.operators.matchup import counter_matchups, pitch_layout
from pitchside.operators.positions import primary_category
from pitchside.operators.scoring import league_percentiles, pct_col, season_filter, top_k_by_aspect, weighted_scores


def player_table(matches: DataFrame, weights: Mapping[str, Mapping[str, float]] = presets.WEIGHTS,
                 position_map: Mapping[str, str] | None = None, keys: Sequence[str] = ("player_name", "team"),
                 minutes: str = presets.MINUTES_COL, list_col: str = presets.POSITION_COL) -> DataFrame:
    """One row per (player, team) with its scores and ``Most_played_position``; both aggregates and the
    join are on the keys, so a layout by them serves all three."""
    scores = weighted_scores(matches, weights, keys, minutes)
    return scores.join(primary_category(matches, keys, list_col, minutes, mapping=position_map), list(keys), "left")


@dataclass
class MatchupResult:
    scored: DataFrame      # one row per (player, team): scores, position, percentiles
    rivals: DataFrame      # rival top-k with category
    own: DataFrame         # own top-k with category
    matchups: DataFrame    # one row per rival row, own pick + both percentiles
    pitch: DataFrame       # one row per own position


def player_matchups(matches: DataFrame, rival_teams: Sequence[str] | None, own_team: str,
                    season: int | None = presets.DEFAULT_SEASON, season_col: str = "year",
                    k_rival: int = 2, k_own: int = 10,
                    weights: Mapping[str, Mapping[str, float]] = presets.WEIGHTS,
                    position_map: Mapping[str, str] | None = None,
                    keys: Sequence[str] = ("player_name", "team"),
                    minutes: str = presets.MINUTES_COL,
                    list_col: str = presets.POSITION_COL,
                    method: str = "scale", materialize: bool = True) -> MatchupResult:
    """The reference's player cell, for any number of rival teams at once.

    ``rival_teams=None`` takes every team except ``own_team``.
    """
    aspects = list(weights)
    season_rows = season_filter(matches, season, season_col)
    scored = league_percentiles(player_table(season_rows, weights, position_map, keys, minutes, list_col), aspects,
                                method=method, materialize=materialize)
    name_col, team_col = keys
    if rival_teams is None:
        is_rival = f"{q(team_col)} <> {lit_str(own_team)}"
    else:
        is_rival = f"{q(team_col)} IN ({', '.join(lit_str(t) for t in rival_teams)})"
    is_own = f"{q(team_col)} = {lit_str(own_team)}"
    # one ranking for both sides
    players = top_k_by_aspect(scored.filter(f"{is_rival} OR {is_own}"), k_rival, aspects, team_col, name_col, k_of={own_team: k_own})
    rivals, own = players.filter(is_rival), players.filter(is_own)
    if rival_teams is not None and own_team in rival_teams:
        rivals = rivals.filter(f"NOT ({is_own}) OR aspect_rank <= {int(k_rival)}")
    m = counter_matchups(rivals, own, aspects=aspects, name_col=name_col, team_col=team_col, carry=[pct_col(a) for a in aspects])
    return MatchupResult(scored, rivals, own, m, pitch_layout(m))
