"""Team-season summary and team resolution.

One hash aggregate per team with partial aggregation; the season is a range
predicate on the date column so parquet row groups are skipped, and a filter
on one team is pushed below the aggregate by Catalyst.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from pitchside import presets
from pitchside.functions.sql import expr, lit_str, q, run_sql
from pitchside.functions.text import contains_ci_sql, parse_date_sql, py_strip_sql

_INTS = ("tinyint", "smallint", "int", "bigint")


def parse_dates(df: DataFrame, date_col: str = "date") -> DataFrame:
    """A1: a string date column becomes a timestamp (unparsable -> NULL)."""
    if isinstance(df.schema[date_col].dataType, StringType):
        return df.withColumn(date_col, expr(parse_date_sql(q(date_col))))
    return df


def season_predicate(df: DataFrame, year: int, date_col: str = "date") -> str:
    """A2: ``[year-01-01, year+1-01-01)`` as SQL, typed like the column (a range
    predicate, so it is pushed to the parquet scan)."""
    dtype = df.schema[date_col].dataType.simpleString()
    c = q(date_col)
    return (f"{c} >= CAST('{year:04d}-01-01 00:00:00' AS {dtype}) "
            f"AND {c} < CAST('{year + 1:04d}-01-01 00:00:00' AS {dtype})")


def _summary_sql(df: DataFrame, measures: Mapping[str, str], year: int | None, team_col: str, date_col: str, more: str = "") -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = []
    for m, how in measures.items():
        if how == "sum":
            zero = "0L" if types[m] in _INTS else "0D"
            aggs.append(f"coalesce(sum({q(m)}), {zero}) AS {q(m)}")
        elif how == "mean":
            aggs.append(f"avg({q(m)}) AS {q(m)}")
        else:
            raise ValueError(f"unsupported aggregation {how!r} for {m}")
    where = season_predicate(df, year, date_col) if year is not None else "TRUE"
    t = q(team_col)
    cols = ", ".join(q(m) for m in dict.fromkeys([*measures, date_col]))
    return f"""SELECT {t}, {', '.join(aggs)}{more} FROM (
  SELECT {py_strip_sql(t)} AS {t}, {cols} FROM {{m}} WHERE {where})
WHERE {t} IS NOT NULL GROUP BY {t}"""


def season_summary(matches: DataFrame, measures: Mapping[str, str] = presets.TEAM_MEASURES,
                   year: int | None = presets.DEFAULT_SEASON, team_col: str = "team",
                   date_col: str = "date") -> DataFrame:
    """A1-A5: one row per (stripped) team: sums (0 when all missing) and means.

    NULL team rows are dropped (N4); a measure missing in every row sums to 0
    and averages to NULL (N3).
    """
    df = parse_dates(matches, date_col)
    return run_sql({"m": df}, _summary_sql(df, measures, year, team_col, date_col))


def resolve_team(matches: DataFrame, text: str, year: int | None = presets.DEFAULT_SEASON,
                 team_col: str = "team", date_col: str = "date", require: bool = False) -> DataFrame:
    """A4: the first team whose name contains ``text`` (case-insensitive).

    "First" is the earliest ``(date, team)`` of the season; zero rows when
    nothing matches, or with ``require`` an error when the plan runs (the
    reference raises ``IndexError``).
    """
    df = parse_dates(matches, date_col)
    where = season_predicate(df, year, date_col) if year is not None else "TRUE"
    t, d = q(team_col), q(date_col)
    found = "__m.team"
    if require:
        found = f"CASE WHEN __m IS NULL THEN raise_error({lit_str(f'no team contains {text!r}')}) ELSE __m.team END"
    sql = f"""SELECT {found} AS {t} FROM (
  SELECT min(named_struct('d', {d}, 'team', __t)) AS __m FROM (
    SELECT {py_strip_sql(t)} AS __t, {d} FROM {{m}} WHERE {where})
  WHERE __t IS NOT NULL AND {contains_ci_sql('__t', lit_str(text))})
WHERE __m IS NOT NULL OR {str(require).upper()}"""
    return run_sql({"m": df}, sql)


def team_summary(matches: DataFrame, text: str, measures: Mapping[str, str] = presets.TEAM_MEASURES,
                 year: int | None = presets.DEFAULT_SEASON, team_col: str = "team",
                 date_col: str = "date") -> DataFrame:
    """The summary row of the resolved team: the first date of each team is summed up with it,
    and the earliest of the teams that match is taken."""
    df = parse_dates(matches, date_col)
    each = _summary_sql(df, measures, year, team_col, date_col, f", min({q(date_col)}) AS __since")
    sql = f"""SELECT * EXCEPT (__since) FROM ({each})
WHERE {contains_ci_sql(q(team_col), lit_str(text))} ORDER BY __since, {q(team_col)} LIMIT 1"""
    return run_sql({"m": df}, sql)
