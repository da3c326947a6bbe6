"""OCR tokens -> attack lanes per image -> lane profile.

The reference walks the tokens of an image left to right with a small state
machine: the 1st valid ``'a / x XG'`` token is the left lane, the 2nd the
middle, every later one overwrites the right lane; percent tokens fill their
own three slots the same way. That is "first, second, last of the valid tokens in
(x, seq) order":

* the first two by ``row_number() <= 2``, which Spark limits per group before
  the shuffle, so a hot image sends two rows per kind and task;
* the last and the counts by one partial aggregate;
* both as a few rows per image, put together by a last aggregate. Raw tokens are
  neither shuffled nor joined; they are read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.numeric import pandas_divide_sql
from pitchside.functions.sql import lit_str, q, run_sql
from pitchside.functions.text import py_fixed_sql, py_int_sql

LANE_FIELDS = [f"{lane}_{k}" for lane in presets.LANES for k in ("attempts", "XG", "percent")]
MEAN_FIELDS = [f"{lane}_{k}" for lane in presets.LANES for k in ("attempts", "XG")]


def _classify_steps(text_col: str) -> list[tuple[str, str]]:
    t = q(text_col)
    is_lane = f"(contains({t}, '/') AND contains({t}, 'XG'))"
    xg_txt = f"regexp_extract({t}, {lit_str(presets.XG_PATTERN)}, 1)"
    parsed = (f"SELECT *, CASE WHEN {is_lane} THEN 'lane' WHEN contains({t}, '%') THEN 'percent' END AS kind, "
              f"CASE WHEN {is_lane} THEN {py_int_sql(f'substring_index({t}, {chr(39)}/{chr(39)}, 1)')} END AS __a, "
              f"CASE WHEN {is_lane} THEN (CASE WHEN {xg_txt} <> '' "
              f"THEN try_cast(replace({xg_txt}, '<', '') AS DOUBLE) END) END AS __x, "
              f"CASE WHEN NOT {is_lane} AND contains({t}, '%') THEN {py_int_sql(f'replace({t}, {chr(39)}%{chr(39)}, {chr(39)}{chr(39)})')} END "
              f"AS __p FROM {{tokens}}")
    lane_ok = "(kind = 'lane' AND __a IS NOT NULL AND __x IS NOT NULL)"
    pct_ok = "(kind = 'percent' AND __p IS NOT NULL)"
    derived = (f"SELECT * EXCEPT (__a, __x, __p), "
               f"CASE WHEN {lane_ok} THEN __a END AS attempts, CASE WHEN {lane_ok} THEN __x END AS xg, "
               f"__p AS percent, coalesce({lane_ok} OR {pct_ok}, false) AS valid, "
               f"kind IS NOT NULL AND NOT coalesce({lane_ok} OR {pct_ok}, false) AS rejected FROM {{parsed}}")
    return [("parsed", parsed), ("classified", derived)]


def classify_tokens(tokens: DataFrame, text_col: str = "text") -> DataFrame:
    """Parse every token once.

    Adds ``kind`` ('lane' | 'percent' | NULL), ``attempts`` (bigint), ``xg``
    (double), ``percent`` (bigint), ``valid`` and ``rejected``. A lane token
    needs both parts to parse; otherwise it is rejected and does not advance
    the lane counter.
    """
    return run_sql({"tokens": tokens}, "SELECT * FROM {classified}", _classify_steps(text_col))


def attack_lanes(tokens: DataFrame, images: DataFrame | None = None, image_col: str = "image_id",
                 order_cols: Sequence[str] = ("x", "seq"), text_col: str = "text") -> DataFrame:
    """One row per image with the nine lane fields and a reject count.

    ``order_cols`` is the left-to-right order with detection order as the tie
    break (Python's stable sort). ``images`` (one ``image_col`` per image)
    keeps images without any token, with all fields NULL.
    """
    img = q(image_col)
    order = ", ".join(q(c) for c in order_cols)
    key = "named_struct(" + ", ".join(f"'k{i}', {q(c)}" for i, c in enumerate(order_cols)) + ")"
    steps = _classify_steps(text_col) + [
        ("c", f"""SELECT {img}, {', '.join(q(c) for c in order_cols)}, CASE WHEN valid THEN kind END AS __kind,
       attempts AS __a, xg AS __x, percent AS __p, rejected FROM {{classified}}"""),
        # invalid tokens rank among themselves (kind NULL) instead of being
        # filtered out: a filter would be pushed below the classification and
        # evaluate it twice
        ("heads", f"""SELECT {img}, __kind, __rn, __a, __x, __p FROM (
  SELECT *, row_number() OVER (PARTITION BY {img}, __kind ORDER BY {order}) AS __rn FROM {{c}}) WHERE __rn <= 2"""),
        ("tails", f"""SELECT {img}, max(CASE WHEN __kind = 'lane' THEN named_struct('k', {key}, 'a', __a, 'x', __x) END) AS __ll,
       max(CASE WHEN __kind = 'percent' THEN named_struct('k', {key}, 'p', __p) END) AS __pl,
       count_if(__kind = 'lane') AS __ln, count_if(__kind = 'percent') AS __pn, count_if(rejected) AS rejects
FROM {{c}} GROUP BY {img}"""),
        ("parts", f"""SELECT {img}, __kind, __rn, __a, __x, __p, CAST(NULL AS BIGINT) AS __la, CAST(NULL AS DOUBLE) AS __lx,
       CAST(NULL AS BIGINT) AS __lp, 0L AS __ln, 0L AS __pn, 0L AS rejects FROM {{heads}}
UNION ALL SELECT {img}, NULL, NULL, NULL, NULL, NULL, __ll.a, __ll.x, __pl.p, __ln, __pn, rejects FROM {{tails}}"""),
    ]

    def nth(kind: str, n: int, value: str) -> str:
        return f"max(CASE WHEN __kind = '{kind}' AND __rn = {n} THEN {value} END)"

    steps.append(("lanes", f"""SELECT {img},
       {nth('lane', 1, '__a')} AS left_attempts, {nth('lane', 1, '__x')} AS left_XG, {nth('percent', 1, '__p')} AS left_percent,
       {nth('lane', 2, '__a')} AS mid_attempts, {nth('lane', 2, '__x')} AS mid_XG, {nth('percent', 2, '__p')} AS mid_percent,
       CASE WHEN max(__ln) >= 3 THEN max(__la) END AS right_attempts, CASE WHEN max(__ln) >= 3 THEN max(__lx) END AS right_XG,
       CASE WHEN max(__pn) >= 3 THEN max(__lp) END AS right_percent, max(rejects) AS rejects
FROM {{parts}} GROUP BY {img}"""))
    sources = {"tokens": tokens}
    if images is None:
        return run_sql(sources, "SELECT * FROM {lanes}", steps)
    sources["images"] = images
    fields = ", ".join(f"l.{f}" for f in LANE_FIELDS)
    sql = f"""SELECT i.{img}, {fields}, coalesce(l.rejects, 0L) AS rejects
FROM (SELECT DISTINCT {img} FROM {{images}}) i LEFT JOIN {{lanes}} l ON i.{img} = l.{img}"""
    return run_sql(sources, sql, steps)


def lane_profile(lanes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the six lane fields per group, xG shares, arrows, labels.

    Percent fields are not averaged. Shares come from the mean xG
    (``lane / (sum of lanes) * 100``, a missing lane counts 0); arrows are
    ``attempts / total * 0.75`` (length) and ``* 10`` (width); labels read
    ``'<int attempts> / <xG .2f> xG\\n<share .0f>%'``.
    """
    grp = ", ".join(q(b) for b in by)
    means = ", ".join(f"avg({f}) AS {f}" for f in MEAN_FIELDS)
    lanes_ = presets.LANES
    total_xg = " + ".join(f"coalesce({lane}_XG, 0D)" for lane in lanes_)
    total_att = " + ".join(f"coalesce({lane}_attempts, 0D)" for lane in lanes_)
    cols = [f"({total_xg}) AS total_XG"]
    for lane in lanes_:
        cols.append(f"{pandas_divide_sql(f'coalesce({lane}_XG, 0D)', f'({total_xg})')} * 100D AS {lane}_share")
    for lane in lanes_:
        ratio = pandas_divide_sql(f"{lane}_attempts", f"({total_att})")
        cols.append(f"{ratio} * 0.75D AS {lane}_arrow_length")
        cols.append(f"{ratio} * 10D AS {lane}_arrow_width")
    labels = []
    for lane in lanes_:
        att = f"{lane}_attempts"
        labels.append(
            f"CASE WHEN {att} IS NOT NULL AND NOT isnan({att}) AND abs({att}) <> CAST('Infinity' AS DOUBLE) "
            f"THEN concat(CAST(CAST({att} AS BIGINT) AS STRING), ' / ', {py_fixed_sql(f'{lane}_XG', 2)}, "
            f"' xG', {lit_str(chr(10))}, {py_fixed_sql(f'{lane}_share', 0)}, '%') END AS {lane}_label")
    group_sel = f"{grp}, " if by else ""
    group_by = f"GROUP BY {grp}" if by else ""
    steps = [("m", f"SELECT {group_sel}{means} FROM {{lanes}} {group_by}"),
             ("f", f"SELECT *, {', '.join(cols)} FROM {{m}}")]
    return run_sql({"lanes": lanes}, f"SELECT *, {', '.join(labels)} FROM {{f}}", steps)
