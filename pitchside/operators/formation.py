"""OCR tokens of the formation crop -> per-image rows -> profile.

Table tokens are read in detection order. A token without digits and with
more than one word is a team row; a token containing '.' that parses as a
float is a value that fills the next of three slots (Total, 1st half,
2nd half) of the *current* team. The slot counter restarts only when a team
is seen for the first time, so a team seen again continues the counter of the
block it interrupts and may overwrite earlier values.

Those running counts are ordered windows partitioned by image. All tokens are
sorted once, by image and order; there each team token takes the values up to
the next one onto its row, and only these team rows are ordered again. So the
memory of a task is that of one sort of its tokens and a few of its team rows.
Team rows and line values meet by image alone: tokens that come dealt by image
are not dealt again, and a task is as large as whoever dealt them made it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.numeric import trunc_to_long_sql
from pitchside.functions.sql import lit_str, q, run_sql
from pitchside.functions.text import contains_ci_sql, py_fixed_sql, py_float_sql, py_isdigit_sql, py_strip_sql

SLOTS = presets.FORMATION_COLUMNS
INTERVALS = presets.FORMATION_INTERVALS
_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_LINE = "(CASE p.colour WHEN 'black' THEN w.black ELSE w.blue END)"


def _segment_steps(image_col: str, seq_col: str, text_col: str, carry: Sequence[str] = ()) -> list[tuple[str, str]]:
    """``segments``: one row per team token, with the values that follow it up to the next team token (three at most
    can count), how many values of its block lie before (``__off``) and the first sighting of the team."""
    img, seq, t = q(image_col), q(seq_col), q(text_col)
    stripped = py_strip_sql(t)
    words = f"(CASE WHEN {stripped} = '' THEN 0 ELSE size(split({stripped}, '\\\\s+')) END)"
    more = "".join(f", {q(c)}" for c in carry)
    n = range(1, len(SLOTS) + 1)
    by_seq = f"OVER (PARTITION BY {img} ORDER BY {seq})"
    leads = ", ".join(f"lead(__num, {k}) {by_seq} AS __n{k}, lead({seq}, {k}) {by_seq} AS __q{k}" for k in n)
    # a value without a place in the order is counted, but it fills no slot of a row
    values = ", ".join(f"CASE WHEN {' AND '.join(f'__n{j} IS NOT NULL' for j in n[:k])} THEN __n{k} END AS __x{k}, "
                       f"CASE WHEN {' AND '.join(f'__n{j} IS NOT NULL' for j in n[:k])} AND __q{k} IS NOT NULL THEN __n{k} END AS __v{k}" for k in n)
    count = "CASE " + " ".join(f"WHEN __n{k} IS NULL THEN {k - 1}" for k in n) + f" ELSE {len(SLOTS)} END"
    return [
        # team and value tokens alone, each parsed once (a filter would be pushed below the parsing and parse again)
        ("t1", f"""SELECT {img}, {seq}{more}, inline(CASE
  WHEN NOT {t} RLIKE '[0-9]' AND {words} > 1 THEN array(named_struct('__team', {t}, '__num', CAST(NULL AS DOUBLE)))
  WHEN contains({t}, '.') THEN filter(array(named_struct('__team', CAST(NULL AS STRING), '__num', {py_float_sql(t)})), e -> e.__num IS NOT NULL)
  END) FROM {{tokens}}"""),
        ("t2", f"SELECT *, row_number() {by_seq} AS __pos, {leads} FROM {{t1}}"),
        ("t3", f"SELECT *, {count} AS __c, {values} FROM {{t2}} WHERE __team IS NOT NULL"),
        # in the order they have already
        ("t4", f"SELECT *, coalesce(sum(__c) OVER (PARTITION BY {img} ORDER BY {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __before FROM {{t3}}"),
        # first sighting; the same among places in the order; the place itself
        ("t5", f"""SELECT *, min(__pos) OVER (PARTITION BY {img}, __team) AS __first, min(CASE WHEN {seq} IS NOT NULL THEN __pos END) OVER (PARTITION BY {img}, __team) AS __seen,
       min({seq}) OVER (PARTITION BY {img}, __team) AS __seen_seq FROM {{t4}}"""),
        ("segments", f"""SELECT *, __before - last(CASE WHEN __pos = __first THEN __before END, true)
       OVER (PARTITION BY {img} ORDER BY __pos {_RUN}) AS __off FROM {{t5}}"""),
    ]


def table_cells(tokens: DataFrame, image_col: str = "image_id", seq_col: str = "seq",
                text_col: str = "text") -> DataFrame:
    """Assign each table value to (team, slot).
    -> ``image_col, team, slot (1..3), value, seq, first_seq``."""
    img, seq = q(image_col), q(seq_col)
    found = ", ".join(f"named_struct('slot', __off + {k}, 'value', __x{k}, 'seq', __q{k})" for k in range(1, len(SLOTS) + 1))
    sql = f"""SELECT {img}, team, e.slot, e.value, e.seq AS {seq}, first_seq FROM (
  SELECT {img}, __team AS team, __seen_seq AS first_seq, explode(array({found})) AS e FROM {{segments}})
WHERE e.value IS NOT NULL AND e.slot <= {len(SLOTS)}"""
    return run_sql({"tokens": tokens}, sql, _segment_steps(image_col, seq_col, text_col))


def _rows_steps(image_col: str, seq_col: str, text_col: str, carry: Sequence[str] = ()) -> list[tuple[str, str]]:
    """``complete``: the complete team rows of each image; ``rows``: the same, numbered."""
    img = q(image_col)
    n = range(1, len(SLOTS) + 1)
    at = ["CASE __off " + " ".join(f"WHEN {off} THEN __v{k - off}" for off in range(k)) + f" END AS __s{k}" for k in n]
    slots = ", ".join(f"max_by(__s{k}, CASE WHEN __s{k} IS NOT NULL THEN __pos END) AS {q(s)}" for k, s in zip(n, SLOTS))
    kept = "".join(f", first({q(c)}, true) AS {q(c)}" for c in carry)
    more = "".join(f", {q(c)}" for c in carry)
    complete = " AND ".join(f"{q(s)} IS NOT NULL" for s in SLOTS)
    return _segment_steps(image_col, seq_col, text_col, carry) + [
        ("placed", f"SELECT {img}, __team AS team, __pos, __seen, {', '.join(at)}{more} FROM {{segments}}"),
        ("complete", f"""SELECT * FROM (
  SELECT {img}, team, min(__seen) AS __seen, {slots}{kept} FROM {{placed}} GROUP BY {img}, team) WHERE {complete}"""),
        ("rows", f"""SELECT {img}, team, {', '.join(q(s) for s in SLOTS)}{more},
       row_number() OVER (PARTITION BY {img} ORDER BY __seen) AS row_no FROM {{complete}}"""),
    ]


def team_rows(tokens: DataFrame, image_col: str = "image_id", seq_col: str = "seq",
              text_col: str = "text") -> DataFrame:
    """Complete team rows per image, numbered in first-sighting order.
    -> ``image_col, team, Total, 1st half, 2nd half, row_no``."""
    return run_sql({"tokens": tokens}, "SELECT * FROM {rows}", _rows_steps(image_col, seq_col, text_col))


def _lines_step(image_col: str, order_cols: Sequence[str], text_col: str, colour_col: str) -> tuple[str, str]:
    """``ranked``: the first six line values of each image and colour, under the names of their columns, so that
    Spark knows them as dealt and sorted already."""
    img, t, colour = q(image_col), q(text_col), q(colour_col)
    order = ", ".join(q(c) for c in order_cols)
    kept = ", ".join(q(c) for c in dict.fromkeys([image_col, colour_col, *order_cols]))
    return ("ranked", f"""SELECT * FROM (
  SELECT {kept}, try_cast({t} AS BIGINT) AS __value, row_number() OVER (PARTITION BY {img}, {colour} ORDER BY {order}) AS __no
  FROM {{line_tokens}} WHERE {py_isdigit_sql(t)})
WHERE __no <= {len(INTERVALS)}""")


def line_values(tokens: DataFrame, image_col: str = "image_id", order_cols: Sequence[str] = ("x", "seq"),
                text_col: str = "text", colour_col: str = "section") -> DataFrame:
    """Digit-only line labels per (image, colour), left to right,
    the first six aligned to the intervals -> ``image_col, colour, interval_no, value``."""
    return run_sql({"line_tokens": tokens}, f"SELECT {q(image_col)}, {q(colour_col)} AS colour, __no AS interval_no, __value AS value FROM {{ranked}}",
                   [_lines_step(image_col, order_cols, text_col, colour_col)])


def _status_steps(select: str, team: str | None, image_col: str, seq_col: str, order_cols: Sequence[str],
                  text_col: str, colour_col: str, carry: Sequence[str], team_col: str | None) -> list[tuple[str, str]]:
    """``picked``: the row of each image that is asked for; ``wide_lines``: black and blue line values per image."""
    img = q(image_col)
    carried = list(dict.fromkeys([*carry, *([team_col] if team_col else [])]))
    steps = _rows_steps(image_col, seq_col, text_col, carried)
    by_seen = f"OVER (PARTITION BY {img} ORDER BY __seen"
    if select == "second":
        steps.append(("picked", "SELECT *, 'blue' AS colour FROM {rows} WHERE row_no = 2"))
    elif select == "name":
        if team_col:
            needle = q(team_col)
        elif team is not None:
            needle = lit_str(team)
        else:
            raise ValueError("select='name' needs a team")
        # the first complete row of the team, counted in the order of the row numbers, so that nothing is sorted again
        steps.append(("picked", f"""SELECT * EXCEPT (__match, __seen, __nth), CASE WHEN row_no = 1 THEN 'black' ELSE 'blue' END AS colour
FROM (SELECT *, row_number() {by_seen}) AS row_no, count_if(__match) {by_seen} {_RUN}) AS __nth
      FROM (SELECT *, {contains_ci_sql('team', needle)} AS __match FROM {{complete}}))
WHERE __match AND __nth = 1"""))
    else:
        raise ValueError("select must be 'name' or 'second'")
    # the six values on the first of their rows: ordered like the rank, so the rows stay as they were sorted for it
    after = f"OVER (PARTITION BY {img}, {q(colour_col)} ORDER BY {', '.join(q(c) for c in order_cols)})"
    ints = ", ".join(f"lead(__value, {i}) {after} AS {q(lbl)}" if i else f"__value AS {q(lbl)}" for i, lbl in enumerate(INTERVALS))
    line = ", ".join(f"'{lbl}', {q(lbl)}" for lbl in INTERVALS)
    lines = ", ".join(f"first(CASE WHEN colour = '{c}' THEN named_struct('__six', __six, {line}) END, true) AS {c}" for c in ("black", "blue"))
    steps.append(_lines_step(image_col, order_cols, text_col, colour_col))
    # both lines on one row of the image: its team row is joined by the image alone, so rows dealt by image stay where they are
    steps.append(("wide_lines", f"""SELECT {img}, {lines} FROM (
  SELECT {img}, {q(colour_col)} AS colour, __no, lead(true, {len(INTERVALS) - 1}, false) {after} AS __six, {ints} FROM {{ranked}})
WHERE __no = 1 GROUP BY {img}"""))
    return steps


def formation_rows(table_tokens: DataFrame, line_tokens: DataFrame, select: str = "name",
                   team: str | None = None, image_col: str = "image_id",
                   seq_col: str = "seq", order_cols: Sequence[str] = ("x", "seq"),
                   text_col: str = "text", colour_col: str = "section",
                   carry: Sequence[str] = (), team_col: str | None = None) -> DataFrame:
    """One row per accepted image with the team row and six line values.

    ``select="second"`` is what the reference does in practice (it tests the
    team name against the column labels, which never match): the second
    complete row with the blue line. ``select="name"`` takes the complete row
    whose text contains the team (case-insensitive; ``team`` literal or the
    per-image ``team_col`` of ``table_tokens``): the first row reads the black
    line, the second the blue one. Images without such a row, or with fewer
    than six line values, are left out (the reference raises);
    ``formation_rejects`` names them. ``carry`` columns of the table tokens are
    constant per image and kept.
    """
    img = q(image_col)
    steps = _status_steps(select, team, image_col, seq_col, order_cols, text_col, colour_col, carry, team_col)
    out_cols = ", ".join([f"p.{img}", *[f"p.{q(c)}" for c in carry], "p.team", "p.colour",
                          *[f"p.{q(s)}" for s in SLOTS], *[f"{_LINE}.{q(i)} AS {q(i)}" for i in INTERVALS]])
    sql = f"""SELECT {out_cols} FROM {{picked}} p
JOIN {{wide_lines}} w ON p.{img} = w.{img} WHERE p.row_no <= 2 AND {_LINE}.__six"""
    return run_sql({"tokens": table_tokens, "line_tokens": line_tokens}, sql, steps)


def formation_rejects(table_tokens: DataFrame, line_tokens: DataFrame, select: str = "name",
                      team: str | None = None, image_col: str = "image_id",
                      seq_col: str = "seq", order_cols: Sequence[str] = ("x", "seq"),
                      text_col: str = "text", colour_col: str = "section",
                      team_col: str | None = None) -> DataFrame:
    """Every image with table tokens that ``formation_rows`` leaves out, and why:
    ``no row`` (no complete row of the team), ``row beyond the second`` (no line is drawn for it)
    or ``fewer than six line values``."""
    img = q(image_col)
    steps = _status_steps(select, team, image_col, seq_col, order_cols, text_col, colour_col, (), team_col)
    sql = f"""SELECT {img}, reason FROM (
  SELECT i.{img}, CASE WHEN p.row_no IS NULL THEN 'no row' WHEN p.row_no > 2 THEN 'row beyond the second'
                       WHEN NOT coalesce({_LINE}.__six, false) THEN 'fewer than six line values' END AS reason
  FROM (SELECT DISTINCT {img} FROM {{tokens}}) i LEFT JOIN {{picked}} p ON i.{img} = p.{img}
  LEFT JOIN {{wide_lines}} w ON p.{img} = w.{img}) WHERE reason IS NOT NULL"""
    return run_sql({"tokens": table_tokens, "line_tokens": line_tokens}, sql, steps)


def _filled_sql() -> str:
    """A row counts only if one of its nine values is not zero."""
    return "(" + " OR ".join(f"coalesce({q(c)} <> 0, false)" for c in SLOTS + INTERVALS) + ")"


def formation_profile(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Leave out empty rows (no value but zeros), truncate every value to an integer, average per label, wide.

    Adds the plot bounds ``y_low``/``y_high`` (min/max of the six interval
    means -+ 10 % of their range) and one-decimal text of Total and both halves.
    """
    labels = SLOTS + INTERVALS
    grp = ", ".join(q(b) for b in by)
    means = ", ".join(f"avg({trunc_to_long_sql(q(c))}) AS {q(c)}" for c in labels)
    ivals = ", ".join(q(c) for c in INTERVALS)
    lo, hi = f"least({ivals})", f"greatest({ivals})"
    group_sel = f"{grp}, " if by else ""
    group_by = f"GROUP BY {grp}" if by else ""
    sql = f"""SELECT *, {lo} - ({hi} - {lo}) * 0.1D AS y_low, {hi} + ({hi} - {lo}) * 0.1D AS y_high,
       {py_fixed_sql(q('Total'), 1)} AS total_text, {py_fixed_sql(q('1st half'), 1)} AS first_half_text,
       {py_fixed_sql(q('2nd half'), 1)} AS second_half_text
FROM (SELECT {group_sel}{means} FROM {{rows}} WHERE {_filled_sql()} {group_by or 'HAVING count(1) > 0'})"""
    return run_sql({"rows": rows}, sql)


def formation_long(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """T18 in the reference's long shape: ``by..., label, value`` (mean), without empty rows."""
    labels = SLOTS + INTERVALS
    grp = [q(b) for b in by]
    stack = ", ".join(f"{lit_str(c)}, CAST({q(c)} AS DOUBLE)" for c in labels)
    keys = ", ".join(grp + ["label"])
    sel = ", ".join(grp)
    sql = f"""SELECT {keys}, avg({trunc_to_long_sql('v')}) AS value FROM (
  SELECT {sel + ', ' if sel else ''}stack({len(labels)}, {stack}) AS (label, v) FROM {{rows}} WHERE {_filled_sql()})
GROUP BY {keys}"""
    return run_sql({"rows": rows}, sql)
