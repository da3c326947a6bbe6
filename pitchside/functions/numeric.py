"""pandas arithmetic rules under Spark's ANSI mode.

Each rule exists as SQL text (``*_sql``, composable inside larger
expressions) and as a ``Column`` (one ``F.expr`` call). Arguments are SQL
expression text; a bare column name is one (backtick names with spaces).
"""

from __future__ import annotations

from pyspark.sql import Column

from pitchside.functions.sql import dbl, expr, sql_of

POS_INF = float("inf")
NEG_INF = float("-inf")


def nan_to_null_sql(x: str) -> str:
    """NaN is pandas' missing value; in Spark it is an ordinary value.
    ``nanvl`` references its input once."""
    return f"nanvl(CAST({x} AS DOUBLE), CAST(NULL AS DOUBLE))"


def pandas_divide_sql(n: str, d: str) -> str:
    """``n / d`` as NumPy float division: x/0 -> +-inf, 0/0 -> NaN (here NULL).
    ANSI Spark raises on ``x / 0``; ``try_divide`` gives NULL, never inf (N1)."""
    return (f"CASE WHEN CAST({d} AS DOUBLE) = 0 THEN "
            f"(CASE WHEN {n} > 0 THEN {dbl(POS_INF)} WHEN {n} < 0 THEN {dbl(NEG_INF)} END) "
            f"ELSE CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0D) END")


def per90_term_sql(metric: str, minutes: str, weight: float) -> str:
    """``metric / minutes * 90 * weight`` per match (P2), a missing result (NULL
    or NaN) already counted as 0 the way ``sum(axis=1)`` skips it (N2).
    At 0 minutes the sign of the metric picks +-inf (N1)."""
    w = float(weight)
    pos = POS_INF * 90.0 * w if w != 0 else 0.0
    neg = NEG_INF * 90.0 * w if w != 0 else 0.0
    m, mins = f"CAST({metric} AS DOUBLE)", f"CAST({minutes} AS DOUBLE)"
    return (f"CASE WHEN {mins} = 0 THEN "
            f"(CASE WHEN {m} > 0 THEN {dbl(pos)} WHEN {m} < 0 THEN {dbl(neg)} ELSE 0D END) "
            f"ELSE coalesce({m} / nullif({mins}, 0D) * 90D * {dbl(w)}, 0D) END")


def skipna_sum_sql(terms: list[str]) -> str:
    """Row-wise ``sum(axis=1)``: missing terms count as 0, all-missing is 0.0;
    ``inf + -inf`` (NaN) becomes NULL so that a later mean skips it (N2)."""
    total = " + ".join(f"coalesce(nanvl(CAST({t} AS DOUBLE), 0D), 0D)" for t in terms)
    return nan_to_null_sql(f"({total})")


def trunc_to_long_sql(x: str) -> str:
    """``astype(int)``: truncation toward zero."""
    return f"CAST(CAST({x} AS DOUBLE) AS BIGINT)"


# --- Column forms --------------------------------------------------------------

def pandas_divide(num, den) -> Column:
    return expr(pandas_divide_sql(sql_of(num), sql_of(den)))
