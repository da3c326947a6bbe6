"""Helpers to hand Spark whole SQL expressions / statements at once.

Every ``pyspark.sql.functions`` call is one or more Python -> JVM round trips.
Building a large expression node by node costs thousands of them; handing the
same expression as SQL text costs one, and Catalyst produces the identical
plan. The operators therefore compose SQL text and use ``selectExpr`` /
``spark.sql`` over temporary views.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_view_ids = itertools.count()


def q(name: str) -> str:
    """Backtick-quote a column name."""
    return "`" + name.replace("`", "``") + "`"


def lit_str(s: str) -> str:
    """A Spark SQL string literal (backslash escapes, \\uXXXX for non-ASCII)."""
    out = []
    for ch in s:
        o = ord(ch)
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif ch == "\n":
            out.append("\\n")
        elif ch == "\t":
            out.append("\\t")
        elif ch == "\r":
            out.append("\\r")
        elif o < 32 or o > 126:
            out.append(f"\\u{o:04x}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def dbl(x: float) -> str:
    """A double literal (handles infinities)."""
    x = float(x)
    if x == float("inf"):
        return "CAST('Infinity' AS DOUBLE)"
    if x == float("-inf"):
        return "CAST('-Infinity' AS DOUBLE)"
    if x != x:
        return "CAST('NaN' AS DOUBLE)"
    return f"{x!r}D"


def expr(sql: str) -> Column:
    return F.expr(sql)


def sql_of(x) -> str:
    """SQL text of an argument: strings are taken as SQL expressions (a bare
    column name is one); Columns are not accepted - pass their SQL."""
    if isinstance(x, str):
        return x
    raise TypeError("pass SQL expression text (str), e.g. a column name")


def project(df: DataFrame, pairs: Iterable[tuple[str, str]], keep: Iterable[str] = ()) -> DataFrame:
    """``SELECT keep..., expr AS name, ...`` in one call."""
    items = [q(k) for k in keep] + [f"{e} AS {q(n)}" for n, e in pairs]
    return df.selectExpr(*items)


def with_columns(df: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """``SELECT *, expr AS name, ...`` in one call (names must be new)."""
    return df.selectExpr("*", *[f"{e} AS {q(n)}" for n, e in pairs])


def run_sql(sources: Mapping[str, DataFrame], sql: str,
            steps: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Run ``sql`` with ``{name}`` placeholders bound to the given frames.

    ``steps`` are named intermediate SELECTs (what a WITH clause would hold);
    each may use the sources and earlier steps. Every frame and step becomes a
    uniquely named temporary view; results are analysed eagerly, so the views
    are dropped again right away. (Plain views instead of WITH clauses keep
    CTE nodes out of plans that are later combined with each other.)
    """
    spark = next(iter(sources.values())).sparkSession
    names: dict[str, str] = {}

    def bind(text: str) -> str:
        for key, view in names.items():
            text = text.replace("{" + key + "}", view)
        return text

    for key, df in sources.items():
        view = f"__ps_{key}_{next(_view_ids)}"
        df.createOrReplaceTempView(view)
        names[key] = view
    try:
        for key, step_sql in steps:
            view = f"__ps_{key}_{next(_view_ids)}"
            spark.sql(bind(step_sql)).createOrReplaceTempView(view)
            names[key] = view
        return spark.sql(bind(sql))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
