"""Driver queries on the test tables and their DuckDB oracle SQL.

Each query runs a library job over whole tables (through ``standins``) and
returns a DataFrame whose column names equal the oracle's. Averages are
rounded to 6 decimals in both engines because summation order is not fixed
across partitionings; ranks are BIGINT in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside import presets
from pitchside.functions.pixels import band_mask_sql
from pitchside.operators.catalog import crop_plan, report_catalog, report_catalogs
from pitchside.operators.formation import formation_long, formation_profile, formation_rejects, formation_rows
from pitchside.operators.grid import (
    accumulate, colour_classes, crop_pixels, crop_sections, formation_boxes, grid_occupancy, image_cells, image_colour_classes,
    image_dims, image_sections, scale_grid, with_gray,
)
from pitchside.operators.lanes import attack_lanes, classify_tokens, lane_profile
from pitchside.operators.masks import combined_masks, image_masks
from pitchside.operators.positions import primary_category
from pitchside.operators.prompt import scouting_prompt
from pitchside.operators.scoring import (
    league_percentiles, pct_col, score_col, season_filter, top_k_by_aspect, weighted_scores,
)
from pitchside.operators.summary import season_summary, team_summary
from pitchside.functions.sql import q
from pitchside.plans import standins as si
from pitchside.plans.player import player_matchups
from pitchside.plans.reports import heatmaps_by_setting

ASPECTS = presets.ASPECTS
SEASON = si.STANDIN_SEASON
OWN = si.STANDIN_OWN_TEAM
K_RIVAL, K_OWN, K_TOP = 2, 10, 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r6(c: str):
    return F.expr(f"round({q(c)}, 6) AS {q(c)}")


# ----------------------------------------------------------------------------
# SQL building blocks (DuckDB dialect)
# ----------------------------------------------------------------------------

def _sql_dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _sql_term(metric: str, weight: float) -> str:
    m, mins = f'"{metric}"', '"Minutes played"'
    div = (f"(CASE WHEN {mins} = 0 THEN (CASE WHEN {m} > 0 THEN CAST('inf' AS DOUBLE) "
           f"WHEN {m} < 0 THEN CAST('-inf' AS DOUBLE) END) ELSE {m} / {mins} END)")
    return f"coalesce({div} * {_sql_dbl(90.0)} * {_sql_dbl(weight)}, {_sql_dbl(0.0)})"


def _sql_total(aspect: str) -> str:
    s = " + ".join(_sql_term(m, w) for m, w in presets.WEIGHTS[aspect].items())
    return f"(CASE WHEN isnan({s}) THEN NULL ELSE {s} END)"


def _sql_scores() -> str:
    aggs = ",\n         ".join(f"avg({_sql_total(a)}) AS {score_col(a)}" for a in ASPECTS)
    return f"""pm AS ({si.PLAYER_MATCH_SQL}),
season AS (SELECT * FROM pm WHERE year = {SEASON}),
scores AS (
  SELECT player_name, team,
         {aggs}
  FROM season WHERE player_name IS NOT NULL AND team IS NOT NULL
  GROUP BY player_name, team)"""


def _sql_pct(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL ELSE "
            f"(CAST(rank() OVER (ORDER BY {v}) AS DOUBLE) "
            f"+ (CAST(count(*) OVER (PARTITION BY {v}) AS DOUBLE) - 1) / 2) "
            f"/ CAST(count({v}) OVER () AS DOUBLE) END")


def _sql_scored() -> str:
    pcts = ",\n         ".join(f"{_sql_pct(score_col(a))} AS {pct_col(a)}" for a in ASPECTS)
    return f"""{_sql_scores()},
scored AS (
  SELECT *,
         {pcts}
  FROM scores)"""


def _sql_topk(src: str, k: int, where: str) -> str:
    unions = "\n    UNION ALL ".join(
        f"SELECT *, '{a}' AS aspect, {i} AS aspect_order, {score_col(a)} AS __score FROM {src} WHERE {where}"
        for i, a in enumerate(ASPECTS))
    return f"""(SELECT * EXCLUDE (__score, __rn), __rn AS aspect_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY team, aspect
                                 ORDER BY __score DESC NULLS LAST, player_name ASC) AS __rn
    FROM ({unions})) WHERE __rn <= {k})"""


def _sql_case_map(col: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {col} {whens} END)"


def _sql_positions() -> str:
    return f"""kept AS (SELECT * FROM season WHERE NOT ("Position" IS NOT DISTINCT FROM '0')),
codes AS (SELECT player_name, team, unnest(string_split("Position", ', ')) AS code,
                 "Minutes played" AS w FROM kept),
per_code AS (SELECT player_name, team, code, coalesce(sum(w), 0) AS minutes FROM codes
             WHERE code IS NOT NULL AND player_name IS NOT NULL AND team IS NOT NULL
             GROUP BY player_name, team, code),
best_code AS (SELECT player_name, team, code FROM (
    SELECT *, row_number() OVER (PARTITION BY player_name, team ORDER BY minutes DESC, code ASC) AS rn
    FROM per_code) WHERE rn = 1),
ents AS (SELECT DISTINCT player_name, team FROM kept),
cats AS (SELECT DISTINCT e.player_name, e.team,
                {_sql_case_map('b.code', si.STANDIN_POSITION_MAP)} AS Most_played_position
         FROM ents e LEFT JOIN best_code b ON e.player_name = b.player_name AND e.team = b.team)"""


def _sql_matchups() -> str:
    rivals = _sql_topk("scored", K_RIVAL, f"team <> '{OWN}'")
    own = _sql_topk("scored", K_OWN, f"team = '{OWN}'")
    stack = "\n    UNION ALL ".join(
        f"SELECT player_name, team, Most_played_position, '{a}' AS metric, {score_col(a)} AS s FROM own_pool"
        for a in ASPECTS)
    pcts = [pct_col(a) for a in ASPECTS]
    rsel = ", ".join(f"{p} AS rival_{p}" for p in pcts)
    osel = ", ".join(f"{p} AS own_{p}" for p in pcts)
    return f"""{_sql_scored()},
{_sql_positions()},
rivals AS (SELECT DISTINCT t.*, c.Most_played_position FROM {rivals} t
           LEFT JOIN cats c USING (player_name, team)),
own AS (SELECT DISTINCT t.*, c.Most_played_position FROM {own} t
        LEFT JOIN cats c USING (player_name, team)),
own_pool AS (SELECT DISTINCT player_name, team, Most_played_position,
                    {", ".join(score_col(a) for a in ASPECTS)} FROM own),
best AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY Most_played_position, metric
                                 ORDER BY s DESC, player_name ASC, team ASC) AS rn
    FROM ({stack}) WHERE Most_played_position IS NOT NULL AND s IS NOT NULL AND NOT isnan(s))
  WHERE rn = 1),
m AS (
  SELECT r.player_name AS rival_name, r.team AS rival_team, r.Most_played_position AS rival_position,
         r.aspect, r.aspect_rank, r.aspect_order,
         b.player_name AS own_name, b.team AS own_team, b.Most_played_position AS own_position
  FROM rivals r LEFT JOIN best b
    ON b.Most_played_position = {_sql_case_map('r.Most_played_position', presets.COUNTER_POSITION)}
   AND b.metric = {_sql_case_map('r.aspect', presets.COUNTER_ASPECT)}),
rp AS (SELECT DISTINCT player_name, team, {rsel} FROM rivals),
op AS (SELECT DISTINCT player_name, team, {osel} FROM own),
mp AS (SELECT m.*, {", ".join("rp.rival_" + p for p in pcts)}, {", ".join("op.own_" + p for p in pcts)}
       FROM m LEFT JOIN rp ON rp.player_name = m.rival_name AND rp.team = m.rival_team
              LEFT JOIN op ON op.player_name = m.own_name AND op.team = m.own_team)"""


# ----------------------------------------------------------------------------
# player slice
# ----------------------------------------------------------------------------

def _season_rows(spark, d):
    return season_filter(si.player_matches(spark, d), SEASON)


def _scored(spark, d):
    return league_percentiles(weighted_scores(_season_rows(spark, d)), ASPECTS, materialize=True)


SCORE_COLS = [score_col(a) for a in ASPECTS]
PCT_COLS = [pct_col(a) for a in ASPECTS]


@register("per90_scores", f"""WITH {_sql_scores()}
SELECT player_name, team, {", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS)} FROM scores""")
def q_per90_scores(spark, d):
    return weighted_scores(_season_rows(spark, d)).select("player_name", "team",
                                                          *[_r6(c) for c in SCORE_COLS])


@register("league_percentile", f"""WITH {_sql_scored()}
SELECT player_name, team, {", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS)},
       {", ".join(PCT_COLS)} FROM scored""")
def q_league_percentile(spark, d):
    return _scored(spark, d).select("player_name", "team", *[_r6(c) for c in SCORE_COLS], *PCT_COLS)


@register("top_players", f"""WITH {_sql_scored()}
SELECT player_name, team, aspect, aspect_rank,
       {", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLS)}, {", ".join(PCT_COLS)}
FROM {_sql_topk("scored", K_TOP, "TRUE")} t""")
def q_top_players(spark, d):
    top = top_k_by_aspect(_scored(spark, d), K_TOP, ASPECTS)
    return top.select("player_name", "team", "aspect", "aspect_rank",
                      *[_r6(c) for c in SCORE_COLS], *PCT_COLS)


@register("primary_position", f"""WITH pm AS ({si.PLAYER_MATCH_SQL}),
season AS (SELECT * FROM pm WHERE year = {SEASON}),
{_sql_positions()}
SELECT player_name, team, Most_played_position FROM cats""")
def q_primary_position(spark, d):
    return primary_category(_season_rows(spark, d), mapping=si.STANDIN_POSITION_MAP)


def _matchups(spark, d):
    return player_matchups(si.player_matches(spark, d), None, OWN, SEASON, k_rival=K_RIVAL, k_own=K_OWN,
                           position_map=si.STANDIN_POSITION_MAP)


MATCHUP_COLS = ["rival_name", "rival_team", "rival_position", "aspect", "aspect_rank",
                "own_name", "own_team", "own_position",
                *[f"rival_{p}" for p in PCT_COLS], *[f"own_{p}" for p in PCT_COLS]]


@register("counter_matchups", f"""WITH {_sql_matchups()}
SELECT {", ".join(MATCHUP_COLS)} FROM mp""")
def q_counter_matchups(spark, d):
    return _matchups(spark, d).matchups.select(*MATCHUP_COLS)


def _sql_label(prefix: str) -> str:
    parts = []
    for tag, a in (("P", "passing"), ("A", "attacking"), ("D", "defensive")):
        parts.append(f"'{tag}: ' || coalesce(printf('%.1f', {prefix}_{pct_col(a)} * 100), 'nan') || '%'")
    return " || chr(10) || ".join(parts)


_COORD_VALUES = ", ".join(f"('{k}', {x}, {y})" for k, (x, y) in presets.PITCH_COORDS.items())


@register("pitch_layout", f"""WITH {_sql_matchups()},
coords(own_position, own_x, own_y) AS (VALUES {_COORD_VALUES}),
firsts AS (SELECT * FROM (
    SELECT mp.*, c.own_x, c.own_y,
           row_number() OVER (PARTITION BY mp.rival_team, mp.own_position
                              ORDER BY aspect_order, aspect_rank, rival_name) AS rn
    FROM mp JOIN coords c ON c.own_position = mp.own_position) WHERE rn = 1)
SELECT own_position, own_name, own_team, CAST(own_x AS INTEGER) AS own_x, CAST(own_y AS INTEGER) AS own_y,
       {_sql_label('own')} AS own_label, rival_name, rival_team,
       CAST(own_x AS INTEGER) AS rival_x, CAST(own_y + {presets.RIVAL_OFFSET_Y} AS INTEGER) AS rival_y,
       {_sql_label('rival')} AS rival_label
FROM firsts""")
def q_pitch_layout(spark, d):
    return _matchups(spark, d).pitch


# ----------------------------------------------------------------------------
# team summary
# ----------------------------------------------------------------------------


RESOLVE_TEXT = "i"
SUM_COLS = [m for m, how in presets.TEAM_MEASURES.items() if how == "sum"]
MEAN_COLS = [m for m, how in presets.TEAM_MEASURES.items() if how == "mean"]


def _summary_out(df):
    return df.selectExpr("team", *SUM_COLS, *[f"round({c}, 6) AS {c}" for c in MEAN_COLS])


def _sql_summary_body() -> str:
    aggs = ",\n         ".join(
        (f"coalesce(sum({m}), 0) AS {m}" if how == "sum" else f"avg({m}) AS {m}")
        for m, how in presets.TEAM_MEASURES.items())
    return f"""tm AS ({si.TEAM_MATCH_SQL}),
ts AS (SELECT * EXCLUDE (team), trim(team) AS team FROM tm
       WHERE date >= TIMESTAMP '{SEASON}-01-01' AND date < TIMESTAMP '{SEASON + 1}-01-01'),
summary AS (
  SELECT team,
         {aggs}
  FROM ts WHERE team IS NOT NULL GROUP BY team)"""


_SUMMARY_SELECT = ", ".join(["team", *SUM_COLS, *[f"round({c}, 6) AS {c}" for c in MEAN_COLS]])


@register("season_summary", f"""WITH {_sql_summary_body()}
SELECT {_SUMMARY_SELECT} FROM summary""")
def q_season_summary(spark, d):
    return _summary_out(season_summary(si.team_matches(spark, d), year=SEASON))


@register("resolve_team", f"""WITH {_sql_summary_body()},
hits AS (SELECT team, date FROM ts WHERE team IS NOT NULL AND contains(lower(team), lower('{RESOLVE_TEXT}'))),
first_team AS (SELECT team FROM hits ORDER BY date, team LIMIT 1)
SELECT {_SUMMARY_SELECT} FROM summary WHERE team IN (SELECT team FROM first_team)""")
def q_resolve_team(spark, d):
    return _summary_out(team_summary(si.team_matches(spark, d), RESOLVE_TEXT, year=SEASON))


# ----------------------------------------------------------------------------
# attack lanes
# ----------------------------------------------------------------------------

LANE_ORDER = ["x", *si.ORDER_KEYS]
_INT_RE = "[+-]?[0-9]+(_[0-9]+)*"


def _sql_pyint(expr: str) -> str:
    s = f"trim({expr})"
    return f"(CASE WHEN regexp_full_match({s}, '{_INT_RE}') THEN CAST(replace({s}, '_', '') AS BIGINT) END)"


_XG_RE = presets.XG_PATTERN


def _sql_lane_cls() -> str:
    is_lane = "(contains(text, '/') AND contains(text, 'XG'))"
    is_pct = f"(NOT {is_lane} AND contains(text, '%'))"
    att = _sql_pyint("split_part(text, '/', 1)")
    xg_txt = f"regexp_extract(text, '{_XG_RE}', 1)"
    xg = f"(CASE WHEN {xg_txt} <> '' THEN TRY_CAST(replace({xg_txt}, '<', '') AS DOUBLE) END)"
    pct = _sql_pyint("replace(text, '%', '')")
    return f"""tok AS ({si.LANE_TOKEN_SQL}),
cls0 AS (
  SELECT *, CASE WHEN {is_lane} THEN 'lane' WHEN {is_pct} THEN 'percent' END AS kind,
         {att} AS __a, {xg} AS __x, {pct} AS __p
  FROM tok),
cls AS (
  SELECT * EXCLUDE (__a, __x, __p),
         CASE WHEN kind = 'lane' AND __a IS NOT NULL AND __x IS NOT NULL THEN __a END AS attempts,
         CASE WHEN kind = 'lane' AND __a IS NOT NULL AND __x IS NOT NULL THEN __x END AS xg,
         CASE WHEN kind = 'percent' THEN __p END AS percent
  FROM cls0),
cls2 AS (
  SELECT *, coalesce((kind = 'lane' AND attempts IS NOT NULL) OR (kind = 'percent' AND percent IS NOT NULL),
                     FALSE) AS valid
  FROM cls)"""


def _sql_lanes() -> str:
    order = ", ".join(LANE_ORDER)
    return f"""{_sql_lane_cls()},
lv AS (SELECT image_id, attempts, xg,
              row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS n,
              count(*) OVER (PARTITION BY image_id) AS cnt
       FROM cls2 WHERE valid AND kind = 'lane'),
pv AS (SELECT image_id, percent,
              row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS n,
              count(*) OVER (PARTITION BY image_id) AS cnt
       FROM cls2 WHERE valid AND kind = 'percent'),
rj AS (SELECT image_id, count(*) AS rejects FROM cls2 WHERE kind IS NOT NULL AND NOT valid GROUP BY image_id),
imgs AS (SELECT DISTINCT image_id, team FROM ({si.IMAGE_SQL})),
lanes AS (
  SELECT i.image_id, i.team,
         l1.attempts AS left_attempts, l1.xg AS left_XG, p1.percent AS left_percent,
         l2.attempts AS mid_attempts, l2.xg AS mid_XG, p2.percent AS mid_percent,
         l3.attempts AS right_attempts, l3.xg AS right_XG, p3.percent AS right_percent,
         coalesce(rj.rejects, 0) AS rejects
  FROM imgs i
  LEFT JOIN lv l1 ON l1.image_id = i.image_id AND l1.n = 1
  LEFT JOIN lv l2 ON l2.image_id = i.image_id AND l2.n = 2
  LEFT JOIN lv l3 ON l3.image_id = i.image_id AND l3.n = l3.cnt AND l3.cnt >= 3
  LEFT JOIN pv p1 ON p1.image_id = i.image_id AND p1.n = 1
  LEFT JOIN pv p2 ON p2.image_id = i.image_id AND p2.n = 2
  LEFT JOIN pv p3 ON p3.image_id = i.image_id AND p3.n = p3.cnt AND p3.cnt >= 3
  LEFT JOIN rj ON rj.image_id = i.image_id)"""


@register("lane_tokens", f"""WITH {_sql_lane_cls()}
SELECT image_id, {", ".join(si.ORDER_KEYS)}, kind, attempts, xg, percent, valid,
       (kind IS NOT NULL AND NOT valid) AS rejected
FROM cls2""")
def q_lane_tokens(spark, d):
    c = classify_tokens(si.lane_tokens(spark, d))
    return c.select("image_id", *si.ORDER_KEYS, "kind", "attempts", "xg", "percent", "valid", "rejected")


LANE_FIELDS = [f"{lane}_{k}" for lane in presets.LANES for k in ("attempts", "XG", "percent")]


def _lanes(spark, d):
    imgs = si.report_images(spark, d, by_order=True)
    lanes = attack_lanes(si.lane_tokens(spark, d, by_order=True), images=imgs, order_cols=LANE_ORDER)
    return lanes.join(imgs, "image_id")


@register("attack_lanes", f"""WITH {_sql_lanes()}
SELECT image_id, {", ".join(LANE_FIELDS)}, rejects FROM lanes""")
def q_attack_lanes(spark, d):
    return _lanes(spark, d).select("image_id", *LANE_FIELDS, "rejects")


PROFILE_NUM = ([f"{lane}_{k}" for lane in presets.LANES for k in ("attempts", "XG")] + ["total_XG"]
               + [f"{lane}_share" for lane in presets.LANES]
               + [f"{lane}_arrow_{k}" for lane in presets.LANES for k in ("length", "width")])
PROFILE_TXT = [f"{lane}_label" for lane in presets.LANES]


def _sql_lane_profile() -> str:
    means = ", ".join(f"avg({lane}_{k}) AS {lane}_{k}" for lane in presets.LANES for k in ("attempts", "XG"))
    tx = " + ".join(f"coalesce({lane}_XG, 0)" for lane in presets.LANES)
    ta = " + ".join(f"coalesce({lane}_attempts, 0)" for lane in presets.LANES)
    share = ", ".join(
        f"CASE WHEN ({tx}) = 0 THEN (CASE WHEN coalesce({lane}_XG, 0) > 0 THEN CAST('inf' AS DOUBLE) END) "
        f"ELSE coalesce({lane}_XG, 0) / ({tx}) END * 100 AS {lane}_share" for lane in presets.LANES)
    arrows = ", ".join(
        f"{lane}_attempts / nullif({ta}, 0) * 0.75 AS {lane}_arrow_length, "
        f"{lane}_attempts / nullif({ta}, 0) * 10 AS {lane}_arrow_width" for lane in presets.LANES)
    labels = ", ".join(
        f"CASE WHEN {lane}_attempts IS NOT NULL THEN CAST(CAST(trunc({lane}_attempts) AS BIGINT) AS VARCHAR) "
        f"|| ' / ' || coalesce(printf('%.2f', {lane}_XG), 'nan') || ' xG' || chr(10) "
        f"|| coalesce(printf('%.0f', {lane}_share), 'nan') || '%' END AS {lane}_label"
        for lane in presets.LANES)
    return f"""{_sql_lanes()},
pm AS (SELECT team, {means} FROM lanes GROUP BY team),
pf AS (SELECT *, {tx} AS total_XG, {share}, {arrows} FROM pm),
profile AS (SELECT *, {labels} FROM pf)"""


@register("lane_profile", f"""WITH {_sql_lane_profile()}
SELECT team, {", ".join(f"round({c}, 6) AS {c}" for c in PROFILE_NUM)}, {", ".join(PROFILE_TXT)}
FROM profile""")
def q_lane_profile(spark, d):
    prof = lane_profile(_lanes(spark, d), by=["team"])
    return prof.select("team", *[_r6(c) for c in PROFILE_NUM], *PROFILE_TXT)


# ----------------------------------------------------------------------------
# formation
# ----------------------------------------------------------------------------

SLOT_COLS = presets.FORMATION_COLUMNS
INTERVAL_COLS = presets.FORMATION_INTERVALS
_FORDER = ", ".join(si.ORDER_KEYS)
_FLOAT_RE = (r"[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
             r"([eE][+-]?[0-9]+(_[0-9]+)*)?")


def _q(c: str) -> str:
    return f'"{c}"'


def _sql_formation(select: str) -> str:
    num = (f"(CASE WHEN regexp_full_match(trim(text), '{_FLOAT_RE}') "
           f"THEN TRY_CAST(replace(trim(text), '_', '') AS DOUBLE) END)")
    words = "(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END)"
    if select == "second":
        pick = "SELECT *, 'blue' AS colour FROM rows_ WHERE row_no = 2"
    else:
        pick = """SELECT * EXCLUDE (rn), CASE WHEN row_no = 1 THEN 'black' ELSE 'blue' END AS colour FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row_no) AS rn FROM rows_
      WHERE contains(lower(team), lower(img_team))) WHERE rn = 1 AND row_no <= 2"""
    slot_sel = ", ".join(f"max(CASE WHEN slot = {i + 1} THEN value END) AS {_q(s)}" for i, s in enumerate(SLOT_COLS))
    int_sel = ", ".join(f"max(CASE WHEN interval_no = {i + 1} THEN value END) AS {_q(s)}"
                        for i, s in enumerate(INTERVAL_COLS))
    complete = " AND ".join(f"{_q(s)} IS NOT NULL" for s in SLOT_COLS)
    return f"""tt AS ({si.FORMATION_TABLE_SQL}),
t1 AS (SELECT image_id, team AS img_team, {_FORDER}, text,
              (NOT regexp_matches(text, '[0-9]') AND {words} > 1) AS is_team, {num} AS num
       FROM tt),
t2 AS (SELECT *, is_team AND row_number() OVER (PARTITION BY image_id, text ORDER BY {_FORDER}) = 1 AS is_first
       FROM t1),
t3 AS (SELECT *,
              last(CASE WHEN is_team THEN text END IGNORE NULLS) OVER (
                  PARTITION BY image_id ORDER BY {_FORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur,
              sum(CAST(is_first AS INTEGER)) OVER (
                  PARTITION BY image_id ORDER BY {_FORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blk
       FROM t2),
vals AS (SELECT * FROM (
           SELECT *, count(*) OVER (PARTITION BY image_id, blk ORDER BY {_FORDER}
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slot
           FROM t3 WHERE NOT is_team AND contains(text, '.') AND cur IS NOT NULL AND num IS NOT NULL)
         WHERE slot <= 3),
firsts AS (SELECT image_id, text AS team, {_FORDER} FROM t2 WHERE is_first),
cells AS (SELECT v.image_id, v.cur AS team, v.slot,
                 arg_max(v.num, struct_pack({", ".join(f"{k} := v.{k}" for k in si.ORDER_KEYS)})) AS value
          FROM vals v GROUP BY v.image_id, v.cur, v.slot),
wide AS (SELECT c.image_id, c.team, {slot_sel} FROM cells c GROUP BY c.image_id, c.team),
rows0 AS (SELECT w.*, f.l_linenumber, f.l_partkey, f.l_suppkey, f.l_extendedprice
          FROM wide w JOIN firsts f ON f.image_id = w.image_id AND f.team = w.team WHERE {complete}),
imgteam AS (SELECT DISTINCT image_id, img_team FROM t1),
rows_ AS (SELECT r.* EXCLUDE (l_linenumber, l_partkey, l_suppkey, l_extendedprice), it.img_team,
                 row_number() OVER (PARTITION BY r.image_id ORDER BY {", ".join("r." + k for k in si.ORDER_KEYS)}) AS row_no
          FROM rows0 r JOIN imgteam it ON it.image_id = r.image_id),
picked AS ({pick}),
lt AS ({si.FORMATION_LINE_SQL}),
flv AS (SELECT * FROM (
         SELECT image_id, section AS colour, TRY_CAST(text AS BIGINT) AS value,
                row_number() OVER (PARTITION BY image_id, section ORDER BY x, seq) AS interval_no
         FROM lt WHERE regexp_full_match(text, '[0-9]+'))
       WHERE interval_no <= 6),
flw AS (SELECT image_id, colour, count(*) AS n, {int_sel} FROM flv GROUP BY image_id, colour),
frows AS (SELECT p.image_id, p.img_team, p.team, p.colour,
                 {", ".join("p." + _q(s) for s in SLOT_COLS)}, {", ".join("l." + _q(s) for s in INTERVAL_COLS)}
          FROM picked p JOIN flw l ON l.image_id = p.image_id AND l.colour = p.colour WHERE l.n = 6)"""


_ALL_F = [*SLOT_COLS, *INTERVAL_COLS]
_SQL_FROWS_OUT = ", ".join(["image_id", "img_team AS image_team", "team", "colour", *[_q(c) for c in _ALL_F]])


def _formation_rows(spark, d, select):
    tt = si.formation_table_tokens(spark, d)
    lt = si.formation_line_tokens(spark, d)
    return formation_rows(tt.withColumnRenamed("team", "image_team"), lt, select=select,
                          team_col="image_team" if select == "name" else None,
                          order_cols=("x", "seq"), carry=["image_team"])


def _frows_out(df):
    return df.selectExpr("image_id", "image_team", "team", "colour", *[q(c) for c in _ALL_F])


@register("formation_rows", f"""WITH {_sql_formation('name')}
SELECT {_SQL_FROWS_OUT} FROM frows""")
def q_formation_rows(spark, d):
    return _frows_out(_formation_rows(spark, d, "name"))


@register("formation_second", f"""WITH {_sql_formation('second')}
SELECT {_SQL_FROWS_OUT} FROM frows""")
def q_formation_second(spark, d):
    return _frows_out(_formation_rows(spark, d, "second"))


@register("formation_rejects", f"""WITH {_sql_formation('name')},
any_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row_no) AS rn FROM rows_
                           WHERE contains(lower(team), lower(img_team))) WHERE rn = 1),
st AS (SELECT i.image_id, CASE WHEN p.row_no IS NULL THEN 'no row' WHEN p.row_no > 2 THEN 'row beyond the second'
                               WHEN coalesce(l.n, 0) < 6 THEN 'fewer than six line values' END AS reason
       FROM (SELECT DISTINCT image_id FROM tt) i LEFT JOIN any_row p ON p.image_id = i.image_id
       LEFT JOIN flw l ON l.image_id = p.image_id AND l.colour = CASE WHEN p.row_no = 1 THEN 'black' ELSE 'blue' END)
SELECT image_id, reason FROM st WHERE reason IS NOT NULL""")
def q_formation_rejects(spark, d):
    tt = si.formation_table_tokens(spark, d).withColumnRenamed("team", "image_team")
    return formation_rejects(tt, si.formation_line_tokens(spark, d), select="name", team_col="image_team")


def _sql_fprofile() -> str:
    means = ", ".join(f"avg(CAST(trunc({_q(c)}) AS BIGINT)) AS {_q(c)}" for c in _ALL_F)
    ivals = ", ".join(_q(c) for c in INTERVAL_COLS)
    return f"""{_sql_formation('name')},
fp0 AS (SELECT img_team AS image_team, {means} FROM frows GROUP BY img_team),
fprofile AS (SELECT *, least({ivals}) - (greatest({ivals}) - least({ivals})) * 0.1 AS y_low,
                    greatest({ivals}) + (greatest({ivals}) - least({ivals})) * 0.1 AS y_high,
                    printf('%.1f', "Total") AS total_text, printf('%.1f', "1st half") AS first_half_text,
                    printf('%.1f', "2nd half") AS second_half_text
             FROM fp0)"""


_FP_NUM = [*_ALL_F, "y_low", "y_high"]


@register("formation_profile", f"""WITH {_sql_fprofile()}
SELECT image_team, {", ".join(f"round({_q(c)}, 6) AS {_q(c)}" for c in _FP_NUM)},
       total_text, first_half_text, second_half_text
FROM fprofile""")
def q_formation_profile(spark, d):
    prof = formation_profile(_formation_rows(spark, d, "name"), by=["image_team"])
    return prof.selectExpr("image_team", *[f"round({q(c)}, 6) AS {q(c)}" for c in _FP_NUM],
                           "total_text", "first_half_text", "second_half_text")


@register("formation_long", f"""WITH {_sql_formation('name')},
fl AS ({" UNION ALL ".join(f"SELECT img_team AS image_team, '{c}' AS label, CAST({_q(c)} AS DOUBLE) AS v FROM frows"
                            for c in _ALL_F)})
SELECT image_team, label, round(avg(CAST(trunc(v) AS BIGINT)), 6) AS value FROM fl GROUP BY image_team, label""")
def q_formation_long(spark, d):
    fl = formation_long(_formation_rows(spark, d, "name"), by=["image_team"])
    return fl.select("image_team", "label", F.round("value", 6).alias("value"))


_FV_NONZERO = " OR ".join(f"{_q(c)} <> 0" for c in _ALL_F)


@register("formation_empty_rows", f"""WITH fv AS ({si.FORMATION_VALUE_SQL}),
fp AS (SELECT image_team, {", ".join(f"avg(CAST(trunc({_q(c)}) AS BIGINT)) AS {_q(c)}" for c in _ALL_F)} FROM fv WHERE {_FV_NONZERO} GROUP BY image_team)
SELECT image_team, {", ".join(f"round({_q(c)}, 6) AS {_q(c)}" for c in _ALL_F)} FROM fp""")
def q_formation_empty_rows(spark, d):
    """Formation profile over rows of which one in five holds nothing but zeros."""
    return formation_profile(si.formation_values(spark, d), by=["image_team"]).selectExpr("image_team", *[f"round({q(c)}, 6) AS {q(c)}" for c in _ALL_F])


@register("formation_empty_rows_long", f"""WITH fv AS ({si.FORMATION_VALUE_SQL}),
fl AS ({" UNION ALL ".join(f"SELECT image_team, '{c}' AS label, {_q(c)} AS v FROM fv WHERE {_FV_NONZERO}" for c in _ALL_F)})
SELECT image_team, label, round(avg(CAST(trunc(v) AS BIGINT)), 6) AS value FROM fl GROUP BY image_team, label""")
def q_formation_empty_rows_long(spark, d):
    return formation_long(si.formation_values(spark, d), by=["image_team"]).select("image_team", "label", F.round("value", 6).alias("value"))


# ----------------------------------------------------------------------------
# scouting prompt
# ----------------------------------------------------------------------------

def _sql_pystr(expr: str, kind: str) -> str:
    if kind == "double":
        return (f"coalesce(CASE WHEN isinf({expr}) THEN (CASE WHEN {expr} > 0 THEN 'inf' ELSE '-inf' END) "
                f"WHEN isnan({expr}) THEN 'nan' ELSE CAST({expr} AS VARCHAR) END, 'nan')")
    return f"coalesce(CAST({expr} AS VARCHAR), 'nan')"


def _sql_prompt() -> str:
    ind = "    "
    nl = "chr(10)"

    def lit(s: str) -> str:
        parts = s.split("\n")
        out = []
        for i, p in enumerate(parts):
            if i:
                out.append(nl)
            if p:
                out.append("'" + p.replace("'", "''") + "'")
        return " || ".join(out) if out else "''"

    kinds = {c: ("double" if presets.TEAM_MEASURES.get(c) == "mean" else "int") for c in presets.TEAM_MEASURES}
    stats = [lit("\n")]
    for label, col, suffix in presets.PROMPT_STAT_LINES:
        k = "str" if col == "team" else kinds[col]
        stats += [lit(f"{ind}- {label}: "), _sql_pystr(f"s.{col}", k), lit(f"{suffix}\n")]
    stats.append(lit(ind))
    attack = [lit(f"\n{ind}Attack Side Breakdown:\n")]
    for label, lane in presets.PROMPT_LANE_LINES:
        attack += [lit(f"{ind}- {label}: "), _sql_pystr(f"l.{lane}_attempts", "double"),
                   lit(" attempts, xG: "), _sql_pystr(f"l.{lane}_XG", "double"), lit("\n")]
    attack.append(lit(ind))
    form = [lit(f"\n{ind}Average Formation Possession by Time Period:\n{ind}- Total: "),
            _sql_pystr('f."Total"', "double"), lit(f"%\n{ind}")]
    pieces = ([lit(f"\n{ind}{presets.PROMPT_INTRO}\n\n{ind}Team Stats:\n{ind}")] + stats
              + [lit(f"\n\n{ind}Attack Side Breakdown:\n{ind}")] + attack
              + [lit(f"\n\n{ind}Average Formation Possession:\n{ind}")] + form
              + [lit(f"\n\n{ind}{presets.PROMPT_OUTRO}\n{ind}")])
    return " || ".join(f"({p})" for p in pieces)


# The prompt prints full float reprs; its inputs are rounded to 6 decimals in
# both engines so that summation order cannot change the text.
_LANE_MEANS = [f"{lane}_{k}" for lane in presets.LANES for k in ("attempts", "XG")]


@register("scouting_prompt", f"""WITH {_sql_summary_body()},
{_sql_lane_profile()},
{_sql_fprofile()},
s AS (SELECT * REPLACE ({", ".join(f"round({c}, 6) AS {c}" for c in MEAN_COLS)}) FROM summary),
l AS (SELECT team, {", ".join(f"round({c}, 6) AS {c}" for c in _LANE_MEANS)} FROM profile),
f AS (SELECT image_team, round("Total", 6) AS "Total" FROM fprofile)
SELECT s.team, '{presets.SYSTEM_MESSAGE}' AS system_message, {_sql_prompt()} AS prompt
FROM s LEFT JOIN l ON l.team = s.team LEFT JOIN f ON f.image_team = s.team""")
def q_scouting_prompt(spark, d):
    summary = season_summary(si.team_matches(spark, d), year=SEASON)
    summary = summary.select("team", *SUM_COLS, *[_r6(c) for c in MEAN_COLS])
    lanes = lane_profile(_lanes(spark, d), by=["team"]).select("team", *[_r6(c) for c in _LANE_MEANS])
    form = (formation_profile(_formation_rows(spark, d, "name"), by=["image_team"])
            .selectExpr("image_team AS team", "round(Total, 6) AS Total"))
    return scouting_prompt(summary, lanes, form)


# ----------------------------------------------------------------------------
# grid heatmap
# ----------------------------------------------------------------------------


CELL = (3, 3)
FRACTION = 0.2
_LO_B, _HI_B = presets.GRAY_BAND
_GRAY_SQL = "((4899 * r + 9617 * g + 1868 * b + 8192) >> 14)"


def _sql_grid(gray_expr: str, cell: tuple[int, int] = CELL, fraction: float = FRACTION) -> str:
    ch, cw = cell
    return f"""px AS ({si.PIXEL_SQL}),
pxg AS (SELECT *, {gray_expr} AS gv FROM px),
dims AS (SELECT image_id, max("row") + 1 AS height, max(col) + 1 AS width FROM pxg GROUP BY image_id),
cells AS (SELECT image_id, side, CAST(floor("row" / {ch}) AS INTEGER) AS cell_row,
                 CAST(floor(col / {cw}) AS INTEGER) AS cell_col,
                 sum(CASE WHEN gv >= {_HI_B} OR gv <= {_LO_B} THEN 1 ELSE 0 END) AS marked
          FROM pxg GROUP BY ALL),
flags AS (SELECT c.*, CASE WHEN marked > {float(ch * cw * fraction)!r} THEN 1 ELSE 0 END AS flag
          FROM cells c JOIN dims d USING (image_id)
          WHERE cell_row < CAST(floor(height / {ch}) AS INTEGER) AND cell_col < CAST(floor(width / {cw}) AS INTEGER)),
grid AS (SELECT side, cell_row, cell_col, CAST(sum(flag) AS BIGINT) AS hits FROM flags GROUP BY ALL)"""


@register("grid_occupancy", f"""WITH {_sql_grid('gray')}
SELECT side, cell_row, cell_col, hits FROM grid""")
def q_grid_occupancy(spark, d):
    return grid_occupancy(si.pixels(spark, d), CELL, FRACTION, by=["side"])


@register("grid_log", f"""WITH {_sql_grid('gray')}
SELECT side, cell_row, cell_col, hits, round(ln(1 + hits), 6) AS scaled FROM grid""")
def q_grid_log(spark, d):
    g = scale_grid(grid_occupancy(si.pixels(spark, d), CELL, FRACTION, by=["side"]), "log", by=["side"])
    return g.select("side", "cell_row", "cell_col", "hits", _r6("scaled"))


@register("grid_minmax", f"""WITH {_sql_grid('gray')},
st AS (SELECT side, min(hits) AS lo, max(hits) AS hi FROM grid GROUP BY side)
SELECT g.side, cell_row, cell_col, hits,
       round(CASE WHEN hi = lo THEN NULL ELSE (hits - lo) / CAST(hi - lo AS DOUBLE) END, 6) AS scaled
FROM grid g JOIN st USING (side)""")
def q_grid_minmax(spark, d):
    g = scale_grid(grid_occupancy(si.pixels(spark, d), CELL, FRACTION, by=["side"]), "normalize",
                   by=["side"])
    return g.select("side", "cell_row", "cell_col", "hits", _r6("scaled"))


@register("gray_band", f"""WITH px AS ({si.PIXEL_SQL})
SELECT image_id, "row", col, {_GRAY_SQL} AS gray,
       CAST(({_GRAY_SQL}) >= {_HI_B} OR ({_GRAY_SQL}) <= {_LO_B} AS INTEGER) AS marked
FROM px""")
def q_gray_band(spark, d):
    px = with_gray(si.pixels(spark, d).drop("gray"))
    return px.selectExpr("image_id", "row", "col", "gray", f"{band_mask_sql('gray')} AS marked")


def _sql_hsv() -> str:
    v = "greatest(r, g, b)"
    diff = f"({v} - least(r, g, b))"
    sdiv = f"(CASE WHEN {v} = 0 THEN 0 ELSE CAST(floor({255.0 * 4096!r} / {v} + 0.5) AS INTEGER) END)"
    s = f"(({diff} * {sdiv} + 2048) >> 12)"
    hraw = f"(CASE WHEN {v} = r THEN g - b WHEN {v} = g THEN b - r + 2 * {diff} ELSE r - g + 4 * {diff} END)"
    hdiv = f"(CASE WHEN {diff} = 0 THEN 0 ELSE CAST(floor({180.0 * 4096!r} / ({diff} * 6) + 0.5) AS INTEGER) END)"
    h0 = f"(({hraw} * {hdiv} + 2048) >> 12)"
    h = f"(CASE WHEN {h0} < 0 THEN {h0} + 180 ELSE {h0} END)"
    return h, s, v


def _sql_in_range(h, s, v, lo, hi):
    return (f"({h} BETWEEN {lo[0]} AND {hi[0]} AND {s} BETWEEN {lo[1]} AND {hi[1]} "
            f"AND {v} BETWEEN {lo[2]} AND {hi[2]})")


_H, _S, _V = _sql_hsv()


@register("colour_classes", f"""WITH px AS ({si.PIXEL_SQL})
SELECT image_id, {", ".join(
    f"CAST(sum(CASE WHEN {_sql_in_range(_H, _S, _V, lo, hi)} THEN 1 ELSE 0 END) AS BIGINT) AS {name}_pixels"
    for name, (lo, hi) in presets.HSV_RANGES.items())}
FROM px GROUP BY image_id""")
def q_colour_classes(spark, d):
    return colour_classes(si.pixels(spark, d))


_SQL_CROPS = f"""WITH px AS ({si.PIXEL_SQL}),
dims AS (SELECT image_id, max("row") + 1 AS height, max(col) + 1 AS width FROM px GROUP BY image_id),
boxes AS (
  SELECT image_id, 'table' AS section, 0 AS x0, 0 AS y0, CAST(width AS INTEGER) AS x1,
         CAST(trunc(height * {presets.FORMATION_TOP_FRACTION!r}) AS INTEGER) AS y1 FROM dims
  UNION ALL
  SELECT image_id, 'graph', CAST(trunc(width * {presets.FORMATION_X_RANGE[0]!r}) AS INTEGER),
         CAST(trunc(height * {presets.FORMATION_BOTTOM_FROM!r}) AS INTEGER),
         CAST(trunc(width * {presets.FORMATION_X_RANGE[1]!r}) AS INTEGER), CAST(height AS INTEGER) FROM dims)
SELECT px.image_id, section, "row" - y0 AS "row", col - x0 AS col, gray
FROM px JOIN boxes USING (image_id)
WHERE col >= x0 AND col < x1 AND "row" >= y0 AND "row" < y1"""


@register("crop_pixels", _SQL_CROPS)
def q_crop_pixels(spark, d):
    px = si.pixels(spark, d)
    boxes = formation_boxes(image_dims(px))
    return crop_pixels(px, boxes).select("image_id", "section", "row", "col", "gray")


@register("crop_sections", _SQL_CROPS)
def q_crop_sections(spark, d):
    """The same sections from one read of the pixels, without a join."""
    return crop_sections(si.pixels(spark, d)).select("image_id", "section", "row", "col", "gray")


@register("image_cells_grid", f"""WITH {_sql_grid(_GRAY_SQL)}
SELECT side, cell_row, cell_col, hits FROM grid""")
def q_image_cells_grid(spark, d):
    cells = image_cells(si.images(spark, d), CELL, FRACTION, keep=["side"])
    return accumulate(cells, by=["side"])


@register("grid_sparse", f"""WITH px AS ({si.PIXEL_SQL}),
dims AS (SELECT image_id, max("row") + 1 AS height, max(col) + 1 AS width FROM px GROUP BY image_id),
shape AS (SELECT side, max(height) // {CELL[0]} AS gr, max(width) // {CELL[1]} AS gc FROM px JOIN dims USING (image_id)
          WHERE gray >= {_HI_B} GROUP BY side),
slots AS (SELECT side, gr, gc, unnest(range(gr * gc)) AS i FROM shape),
marks AS (SELECT image_id, side, "row" // {CELL[0]} AS cell_row, col // {CELL[1]} AS cell_col, count(*) AS n
          FROM px WHERE gray >= {_HI_B} GROUP BY ALL),
flags AS (SELECT side, cell_row, cell_col, count(*) AS hits FROM marks WHERE n > {float(CELL[0] * CELL[1] * FRACTION)!r} GROUP BY ALL),
grid AS (SELECT s.side, s.i // s.gc AS cell_row, s.i % s.gc AS cell_col, coalesce(f.hits, 0) AS hits
         FROM slots s LEFT JOIN flags f ON f.side = s.side AND f.cell_row = s.i // s.gc AND f.cell_col = s.i % s.gc),
st AS (SELECT side, min(hits) AS lo, max(hits) AS hi FROM grid GROUP BY side)
SELECT g.side, CAST(cell_row AS INTEGER) AS cell_row, CAST(cell_col AS INTEGER) AS cell_col, CAST(hits AS BIGINT) AS hits,
       round(CASE WHEN hi = lo THEN NULL ELSE (hits - lo) / CAST(hi - lo AS DOUBLE) END, 6) AS scaled
FROM grid g JOIN st USING (side)""")
def q_grid_sparse(spark, d):
    """A table of bright pixels only: cells without any count 0 and take part in the scaling."""
    px = si.pixels(spark, d)
    g = grid_occupancy(px.filter(f"gray >= {_HI_B}"), CELL, FRACTION, by=["side"], dims=image_dims(px))
    return scale_grid(g, "normalize", by=["side"]).select("side", "cell_row", "cell_col", "hits", _r6("scaled"))


@register("image_colour_classes", f"""WITH px AS ({si.PIXEL_SQL})
SELECT 'emb://' || CAST(image_id AS VARCHAR) AS origin, side, {", ".join(
    f"CAST(sum(CASE WHEN {_sql_in_range(_H, _S, _V, lo, hi)} THEN 1 ELSE 0 END) AS BIGINT) AS {name}_pixels"
    for name, (lo, hi) in presets.HSV_RANGES.items())}
FROM px GROUP BY image_id, side""")
def q_image_colour_classes(spark, d):
    return image_colour_classes(si.images(spark, d), keep=["side"])


@register("image_sections", f"""WITH px AS ({si.PIXEL_SQL}),
dims AS (SELECT image_id, max("row") + 1 AS height, max(col) + 1 AS width FROM px GROUP BY image_id),
boxes AS (
  SELECT image_id, 'table' AS section, 0 AS x0, 0 AS y0, CAST(width AS INTEGER) AS x1,
         CAST(trunc(height * {presets.FORMATION_TOP_FRACTION!r}) AS INTEGER) AS y1 FROM dims
  UNION ALL
  SELECT image_id, 'graph', CAST(trunc(width * {presets.FORMATION_X_RANGE[0]!r}) AS INTEGER),
         CAST(trunc(height * {presets.FORMATION_BOTTOM_FROM!r}) AS INTEGER),
         CAST(trunc(width * {presets.FORMATION_X_RANGE[1]!r}) AS INTEGER), CAST(height AS INTEGER) FROM dims)
SELECT 'emb://' || CAST(b.image_id AS VARCHAR) AS origin, section, CAST(max(y1 - y0) AS INTEGER) AS height,
       CAST(max(x1 - x0) AS INTEGER) AS width, upper(string_agg(printf('%02x%02x%02x', b, g, r), '' ORDER BY "row", col)) AS bgr
FROM px JOIN boxes b USING (image_id)
WHERE col >= x0 AND col < x1 AND "row" >= y0 AND "row" < y1 GROUP BY b.image_id, section""")
def q_image_sections(spark, d):
    return image_sections(si.images(spark, d)).select("origin", "section", "height", "width", F.hex("data").alias("bgr"))


SETTINGS = [("fine", (2, 2), 0.2), ("driver", CELL, 0.1), ("wide", (4, 2), 0.5)]


@register("grid_settings", "\nUNION ALL\n".join(f"""SELECT '{name}' AS setting, side, cell_row, cell_col, hits FROM (WITH {_sql_grid(_GRAY_SQL, cell, fraction)}
SELECT * FROM grid)""" for name, cell, fraction in SETTINGS))
def q_grid_settings(spark, d):
    """Three cell sizes and fractions from one decode of the images."""
    return heatmaps_by_setting(si.images(spark, d), SETTINGS, by=["side"])


def _sql_masks() -> str:
    """Runs of the pixels of each class in row-major order, and each image's masks."""
    marks = " UNION ALL ".join(f"SELECT image_id, side, '{name}' AS class, \"row\" * 8 + col AS i, \"row\" AS r, col AS c FROM px WHERE {_sql_in_range(_H, _S, _V, lo, hi)}"
                               for name, (lo, hi) in presets.HSV_RANGES.items())
    return f"""px0 AS ({si.PIXEL_SQL}),
px AS (SELECT * FROM px0),
marks AS ({marks}),
all_ AS (SELECT DISTINCT image_id, side, class FROM px CROSS JOIN (SELECT unnest([{", ".join(f"'{n}'" for n in presets.HSV_RANGES)}]) AS class))"""


_SQL_MASK_ROWS = """isl AS (SELECT *, i - row_number() OVER (PARTITION BY image_id, class ORDER BY i) AS g FROM marks),
runs AS (SELECT image_id, class, min(i) AS s, count(*) AS n, min(r) AS y0, max(r) AS y1, min(c) AS x0, max(c) AS x1 FROM isl GROUP BY image_id, class, g),
coded AS (SELECT image_id, class, CAST(sum(n) AS BIGINT) AS area, min(x0) AS x0, min(y0) AS y0, max(x1) + 1 AS x1, max(y1) + 1 AS y1,
                 string_agg(s || '+' || n, ' ' ORDER BY s) AS runs FROM runs GROUP BY image_id, class)
SELECT 'emb://' || CAST(a.image_id AS VARCHAR) AS origin, a.side, a.class, coalesce(area, 0) AS area, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0,
       CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, coalesce(runs, '') AS runs
FROM all_ a LEFT JOIN coded USING (image_id, class)"""


def _masks_out(df):
    runs = "array_join(transform(arrays_zip(starts, lengths), r -> concat(r.starts, '+', r.lengths)), ' ') AS runs"
    return df.selectExpr("origin", "side", "class", "area", "x0", "y0", "x1", "y1", runs)


@register("image_masks", f"WITH {_sql_masks()},\n{_SQL_MASK_ROWS}")
def q_image_masks(spark, d):
    return _masks_out(image_masks(si.images(spark, d), keep=["side"]))


@register("mask_overlaps", f"""WITH {_sql_masks().replace("marks AS (", "marks0 AS (").replace("all_ AS (", "all0 AS (")},
b AS (SELECT image_id, i FROM marks0 WHERE class = 'blue'),
k AS (SELECT * FROM marks0 WHERE class = 'black'),
marks AS (SELECT image_id, side, 'black_and_blue' AS class, i, r, c FROM k WHERE EXISTS (SELECT 1 FROM b WHERE b.image_id = k.image_id AND b.i = k.i)
          UNION ALL SELECT image_id, side, 'black_minus_blue', i, r, c FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = k.image_id AND b.i = k.i)
          UNION ALL SELECT image_id, side, 'black_or_blue', i, r, c FROM (SELECT DISTINCT image_id, side, i, r, c FROM marks0)),
all_ AS (SELECT DISTINCT image_id, side, 'black_' || how || '_blue' AS class FROM px CROSS JOIN (SELECT unnest(['and', 'minus', 'or']) AS how)),
{_SQL_MASK_ROWS}""")
def q_mask_overlaps(spark, d):
    """Both line masks of each image combined on their runs."""
    masks = image_masks(si.images(spark, d), keep=["side"])
    both = [combined_masks(masks, "black", "blue", how, keep=["side"]) for how in ("and", "minus", "or")]
    return _masks_out(both[0].unionAll(both[1]).unionAll(both[2]))


# ----------------------------------------------------------------------------
# report catalog and crop plan
# ----------------------------------------------------------------------------


CATALOG_COLS = ["folder", "file", "page_count", "team_1", "team_2", "team_slot", "other_team", "image_index"]


def _sql_catalog() -> str:
    team, own = si.STANDIN_TEAM, si.STANDIN_OWN
    word = team.split()[0].lower()
    return f"""files AS ({si.REPORT_SQL}),
fp AS (SELECT *, string_split(path, '/')[-2] AS folder, string_split(path, '/')[-1] AS file FROM files),
tf AS (SELECT min(folder) AS folder FROM fp WHERE contains(lower(folder), '{word}')),
f1 AS (SELECT *, trim(string_split(file, '-')[1]) AS team_1, trim(string_split(file, '-')[2]) AS team_2
       FROM fp WHERE folder IN (SELECT folder FROM tf) AND suffix(file, '.pdf')
         AND NOT contains(lower(file), lower('{own}'))),
f2 AS (SELECT *, CASE WHEN team_2 IS NULL THEN NULL WHEN contains(team_1, '{team}') THEN 1
                      WHEN contains(team_2, '{team}') THEN 2 END AS team_slot FROM f1),
catalog AS (SELECT *, CASE WHEN team_slot = 1 THEN team_2 ELSE team_1 END AS other_team,
                   CAST(row_number() OVER (PARTITION BY folder ORDER BY file, path) AS INTEGER) AS image_index
            FROM f2 WHERE team_slot IS NOT NULL)"""


def _catalog(spark, d):
    return report_catalog(si.report_files(spark, d), si.STANDIN_TEAM, own_team=si.STANDIN_OWN)


@register("report_catalog", f"""WITH {_sql_catalog()}
SELECT {", ".join(CATALOG_COLS)} FROM catalog""")
def q_report_catalog(spark, d):
    return _catalog(spark, d).select(*CATALOG_COLS)


@register("report_catalog_all", f"""WITH files AS ({si.REPORT_SQL}),
fp AS (SELECT *, string_split(path, '/')[-2] AS folder, string_split(path, '/')[-1] AS file FROM files),
teams AS (SELECT n_name || ' United' AS team FROM nation),
tf AS (SELECT team, min(folder) AS folder FROM teams JOIN (SELECT DISTINCT folder FROM fp) d ON contains(lower(d.folder), lower(string_split(team, ' ')[1]))
       GROUP BY team),
f1 AS (SELECT tf.team, fp.*, trim(string_split(file, '-')[1]) AS team_1, trim(string_split(file, '-')[2]) AS team_2
       FROM fp JOIN tf ON fp.folder = tf.folder WHERE suffix(file, '.pdf') AND NOT contains(lower(file), lower('{si.STANDIN_OWN}'))),
f2 AS (SELECT *, CASE WHEN team_2 IS NULL THEN NULL WHEN contains(team_1, string_split(team, ' ')[1]) THEN 1
                      WHEN contains(team_2, string_split(team, ' ')[1]) THEN 2 END AS team_slot FROM f1)
SELECT team, {", ".join(c for c in CATALOG_COLS if c not in ("other_team", "image_index"))}, CASE WHEN team_slot = 1 THEN team_2 ELSE team_1 END AS other_team,
       CAST(row_number() OVER (PARTITION BY team, folder ORDER BY file, path) AS INTEGER) AS image_index
FROM f2 WHERE team_slot IS NOT NULL""")
def q_report_catalog_all(spark, d):
    """The catalogs of all nations' teams in one job; the files name a team by the first word of its full name."""
    teams = si.report_teams(spark, d).selectExpr("team", "split(team, ' ')[0] AS name_in_file")
    return report_catalogs(si.report_files(spark, d), teams, own_team=si.STANDIN_OWN, name_col="name_in_file").select("team", *CATALOG_COLS)


def _sql_crop_spec() -> str:
    rows = [f"({slot}, {no}, '{side}', '{kind}', {base}, {str(shifts).upper()}, {r[0]}, {r[1]}, {r[2]}, {r[3]}, "
            f"'trunc')" for slot, no, side, kind, base, shifts, r in presets.CROP_SPEC]
    side, kind, base, shifts, r = presets.FORMATION_CROP
    rows += [f"({slot}, 5, '{side}', '{kind}', {base}, {str(shifts).upper()}, {r[0]}, {r[1]}, {r[2]}, {r[3]}, "
             f"'round')" for slot in (1, 2)]
    return ("spec(team_slot, crop_no, side, kind, page_base, shifts, x0, y0, x1, y1, rounding) AS (VALUES "
            + ", ".join(rows) + ")")


_SCALE = presets.DPI / presets.BASE_DPI


def _sql_px(c: str) -> str:
    v = f"(CAST(s.{c} AS DOUBLE) * {_SCALE!r})"
    return f"CAST(CASE WHEN rounding = 'round' THEN round_even({v}, 0) ELSE trunc({v}) END AS INTEGER)"


@register("crop_plan", f"""WITH {_sql_catalog()},
{_sql_crop_spec()}
SELECT folder, file, image_index, crop_no, side, kind,
       page_base + CASE WHEN shifts THEN page_count - {presets.BASE_PAGE_COUNT} ELSE 0 END AS page,
       {_sql_px('x0')} AS x0, {_sql_px('y0')} AS y0, {_sql_px('x1')} AS x1, {_sql_px('y1')} AS y1,
       CASE WHEN kind = 'avg_formation'
            THEN kind || '_' || CAST(image_index AS VARCHAR) || '_' || team_1 || '_' || team_2 || '.png'
            WHEN side = 'home_team'
            THEN kind || '_' || CAST(image_index AS VARCHAR) || '_' || '{si.STANDIN_TEAM}' || '_against_' || other_team || '.png'
            ELSE kind || '_' || CAST(image_index AS VARCHAR) || '_' || other_team || '_against_' || '{si.STANDIN_TEAM}' || '.png'
       END AS out_name
FROM catalog c JOIN spec s USING (team_slot)""")
def q_crop_plan(spark, d):
    return crop_plan(_catalog(spark, d))
