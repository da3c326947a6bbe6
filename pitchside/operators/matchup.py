"""Counter-matchups and their pitch layout.

The reference loops over rival rows and scans the own pool per row. Here the
own pool is ranked once per (position, metric) with ``row_number`` (at most
|positions| x |aspects| winners), and rivals are matched with one equi left
join on (counter position, counter aspect). The lookups are literal maps or a
tiny broadcast table; nothing grows with the data except the rival rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.sql import lit_str, q, run_sql
from pitchside.functions.text import py_fixed_sql
from pitchside.operators.positions import map_lookup_sql
from pitchside.operators.scoring import pct_col, score_col


def attach_category(players: DataFrame, categories: DataFrame,
                    keys: Sequence[str] = ("player_name", "team")) -> DataFrame:
    """Left join the primary category on the keys, then ``distinct``."""
    return players.join(categories, list(keys), "left").distinct()


def _best_steps(aspects: Sequence[str], name_col: str, team_col: str, cat_col: str,
                carry: Sequence[str] = ()) -> list[tuple[str, str]]:
    more = "".join(f", {q(c)}" for c in carry)
    own = "".join(f", {q(c)} AS {q('own_' + c)}" for c in carry)
    stack = ", ".join(f"{lit_str(a)}, {q(score_col(a))}" for a in aspects)
    return [
        # a player on several aspects is in the pool several times, which does not change who comes first
        ("pool_long", f"""SELECT {q(name_col)}, {q(team_col)}, {q(cat_col)}{more},
       stack({len(aspects)}, {stack}) AS (metric, __s)
FROM {{own}}
WHERE {q(cat_col)} IS NOT NULL"""),
        ("best", f"""SELECT {q(cat_col)} AS __cat, metric AS __metric, {q(name_col)} AS own_name,
       {q(team_col)} AS own_team, {q(cat_col)} AS own_position{own} FROM (
  SELECT *, row_number() OVER (PARTITION BY {q(cat_col)}, metric
                               ORDER BY __s DESC, {q(name_col)} ASC, {q(team_col)} ASC) AS __rn
  FROM {{pool_long}} WHERE __s IS NOT NULL AND NOT isnan(__s)) WHERE __rn = 1"""),
    ]


def counter_matchups(rivals: DataFrame, own: DataFrame,
                     counter_position: Mapping[str, str] = presets.COUNTER_POSITION,
                     counter_aspect: Mapping[str, str] = presets.COUNTER_ASPECT,
                     aspects: Sequence[str] = presets.ASPECTS,
                     name_col: str = "player_name", team_col: str = "team",
                     cat_col: str = "Most_played_position", carry: Sequence[str] = ()) -> DataFrame:
    """For every rival row, the own player of the counter position
    with the best counter-aspect score; an unmatched rival keeps NULL own
    columns (N8: the reference raises). ``best`` has at most
    |categories| x |aspects| rows, so it is broadcast.

    ``carry``: columns of both sides (the percentiles, P23-P25) that come along
    as ``rival_<c>`` and ``own_<c>``, so that nothing is joined back for them."""
    rival = "".join(f", {q(c)} AS {q('rival_' + c)}" for c in carry)
    out = "".join(f", r.{q('rival_' + c)}" for c in carry) + "".join(f", b.{q('own_' + c)}" for c in carry)
    steps = _best_steps(aspects, name_col, team_col, cat_col, carry) + [
        ("r", f"""SELECT {q(name_col)} AS rival_name, {q(team_col)} AS rival_team, {q(cat_col)} AS rival_position,
       aspect, aspect_rank, aspect_order{rival},
       {map_lookup_sql(q(cat_col), counter_position)} AS __cat,
       {map_lookup_sql('aspect', counter_aspect)} AS __metric FROM {{rivals}}"""),
    ]
    sql = f"""SELECT /*+ BROADCAST(b) */ r.rival_name, r.rival_team, r.rival_position, r.aspect, r.aspect_rank,
       r.aspect_order, b.own_name, b.own_team, b.own_position{out}
FROM {{r}} r LEFT JOIN {{best}} b ON r.__cat = b.__cat AND r.__metric = b.__metric"""
    return run_sql({"rivals": rivals, "own": own}, sql, steps)


def with_percentiles(matches: DataFrame, rivals: DataFrame, own: DataFrame,
                     aspects: Sequence[str] = presets.ASPECTS,
                     name_col: str = "player_name", team_col: str = "team") -> DataFrame:
    """Rival percentiles (left) and own percentiles (left; the
    reference's inner join would hide unmatched rivals, N8). Both sides are
    de-duplicated, so a player on several aspects does not multiply rows."""
    pcts = [pct_col(a) for a in aspects]
    rsel = ", ".join(f"{q(p)} AS {q('rival_' + p)}" for p in pcts)
    osel = ", ".join(f"{q(p)} AS {q('own_' + p)}" for p in pcts)
    out = ", ".join([f"rp.{q('rival_' + p)}" for p in pcts] + [f"op.{q('own_' + p)}" for p in pcts])
    steps = [("rp", f"SELECT DISTINCT {q(name_col)} AS __n, {q(team_col)} AS __t, {rsel} FROM {{rivals}}"),
             ("op", f"SELECT DISTINCT {q(name_col)} AS __n, {q(team_col)} AS __t, {osel} FROM {{own}}")]
    sql = f"""SELECT m.*, {out} FROM {{m}} m
LEFT JOIN {{rp}} rp ON rp.__n = m.rival_name AND rp.__t = m.rival_team
LEFT JOIN {{op}} op ON op.__n = m.own_name AND op.__t = m.own_team"""
    return run_sql({"m": matches, "rivals": rivals, "own": own}, sql, steps)


def _label_sql(prefix: str) -> str:
    """``P: x%\\nA: y%\\nD: z%`` with ``{v*100:.1f}%`` per percentile."""
    parts = []
    for tag, aspect in (("P", "passing"), ("A", "attacking"), ("D", "defensive")):
        v = py_fixed_sql(f"{q(prefix + '_' + pct_col(aspect))} * 100", 1)
        parts.append(f"concat({lit_str(tag + ': ')}, {v}, '%')")
    return f"concat_ws({lit_str(chr(10))}, {', '.join(parts)})"


def pitch_layout(matches: DataFrame,
                 coords: Mapping[str, tuple[int, int]] = presets.PITCH_COORDS,
                 rival_offset: int = presets.RIVAL_OFFSET_Y) -> DataFrame:
    """One pitch per rival team, one row per own position on it.

    The first row per slot wins, in the reference's row order: aspect order
    (defensive, attacking, passing), then rank within the aspect. Positions
    without coordinates are dropped (the reference raises).
    """
    values = ", ".join(f"({lit_str(k)}, {int(x)}, {int(y)})" for k, (x, y) in coords.items())
    steps = [("firsts", f"""SELECT * FROM (
  SELECT /*+ BROADCAST(c) */ m.*, c.own_x, c.own_y,
         row_number() OVER (PARTITION BY m.rival_team, m.own_position
                            ORDER BY aspect_order, aspect_rank, rival_name) AS __rn
  FROM {{m}} m JOIN (SELECT * FROM VALUES {values} AS t(own_position, own_x, own_y)) c
    ON m.own_position = c.own_position) WHERE __rn = 1""")]
    sql = f"""SELECT own_position, own_name, own_team, own_x, own_y, {_label_sql('own')} AS own_label,
       rival_name, rival_team, own_x AS rival_x, own_y + {int(rival_offset)} AS rival_y,
       {_label_sql('rival')} AS rival_label
FROM {{firsts}}"""
    return run_sql({"m": matches}, sql, steps)
