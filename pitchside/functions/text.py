"""Python string semantics as Spark SQL expressions.

Python's ``str.strip``, ``int(str)``, ``float(str)``, ``str.isdigit`` and
``repr(float)`` differ from Spark's ``trim`` and ``cast``; these helpers pin the
Python behaviour with anchored regexes in front of ``try_cast`` so that nothing
raises under ANSI mode and nothing Spark-only (``'4.5d'``) is accepted.

``*_sql`` functions return SQL text (arguments are SQL text, a column name
is one); the plain names return a ``Column``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame

from pitchside.functions.exact import fixed_sql
from pitchside.functions.sql import expr, lit_str, q, sql_of, with_columns

# fixed values: the characters Python's str.strip() removes
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
                 "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
INT_RE = r"^[+-]?[0-9]+(_[0-9]+)*$"
_DIGITS = r"[0-9]+(_[0-9]+)*"
FLOAT_RE = (rf"^[+-]?(({_DIGITS})(\.({_DIGITS})?)?|\.{_DIGITS})"
            rf"([eE][+-]?{_DIGITS})?$")
_E_RE = r"^(-?)([0-9])(?:\.([0-9]+))?e([+-]?[0-9]+)$"
_WS_CLASS = (r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_INF, _NINF = "CAST('Infinity' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)"


def py_strip_sql(x: str) -> str:
    """``str.strip()``: native ``btrim`` over Python's whitespace set (a regex
    here costs two orders of magnitude more per row)."""
    return f"btrim({x}, {lit_str(PY_WHITESPACE)})"


def py_int_sql(x: str) -> str:
    """``int(s)``; NULL where Python raises ``ValueError`` (bigint range)."""
    s = py_strip_sql(x)
    return f"(CASE WHEN {s} RLIKE {lit_str(INT_RE)} THEN try_cast(replace({s}, '_', '') AS BIGINT) END)"


def py_float_sql(x: str) -> str:
    """``float(s)``; NULL where Python raises ``ValueError``."""
    s = py_strip_sql(x)
    low = f"lower({s})"
    return (f"(CASE WHEN {s} RLIKE {lit_str(FLOAT_RE)} THEN try_cast(replace({s}, '_', '') AS DOUBLE) "
            f"WHEN {low} IN ('inf', '+inf', 'infinity', '+infinity') THEN {_INF} "
            f"WHEN {low} IN ('-inf', '-infinity') THEN {_NINF} "
            f"WHEN {low} IN ('nan', '+nan', '-nan') THEN CAST('NaN' AS DOUBLE) END)")


def py_isdigit_sql(x: str) -> str:
    """``str.isdigit()`` restricted to ASCII digits; '' is False."""
    return f"coalesce({x} RLIKE '^[0-9]+$', false)"


def first_word_sql(x: str) -> str:
    """``s.split()[0]``: first run of non-whitespace."""
    return f"regexp_extract({x}, {lit_str('^' + _WS_CLASS + '*([^' + chr(92) + 's]+)')}, 1)"


def contains_ci_sql(haystack: str, needle: str) -> str:
    return f"contains(lower({haystack}), lower({needle}))"


def parse_date_sql(x: str) -> str:
    """A1: text to a timestamp: ISO first, then month/day/year and English month names; else NULL."""
    s = f"btrim({x})"
    formats = ("M/d/yyyy", "M/d/yyyy H:mm[:ss]", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")
    tries = ", ".join([f"try_to_timestamp({s})"] + [f"try_to_timestamp({s}, {lit_str(f)})" for f in formats])
    return f"coalesce({tries})"


def py_fixed_sql(x: str, digits: int) -> str:
    """f-string ``{x:.Nf}``: the exact binary value, half to even; NULL and NaN are ``nan``. Python keeps the sign of a negative
    value that rounds to zero ('-0')."""
    c = f"CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {c} IS NULL OR isnan({c}) THEN 'nan' WHEN {c} = {_INF} THEN 'inf' WHEN {c} = {_NINF} THEN '-inf' "
            f"ELSE {fixed_sql(c, digits)} END)")


def repr_pick_sql(x: str) -> str:
    """Shortest ``%.Ne`` rendering that casts back to the same double
    (``Double.toString`` is not always shortest before JDK 19)."""
    c = f"CAST({x} AS DOUBLE)"
    cands = [f"format_string('%.{p}e', {c})" for p in range(17)]
    return "coalesce(" + ", ".join(f"CASE WHEN try_cast({s} AS DOUBLE) = {c} THEN {s} END" for s in cands) + ")"


def repr_layout_sql(x: str, pick: str, null_text: str = "nan") -> str:
    """Python's layout of the picked digits: positional within [1e-4, 1e16),
    otherwise ``1e+16`` / ``1.5e-05``."""
    c = f"CAST({x} AS DOUBLE)"
    er = lit_str(_E_RE)
    sign = f"regexp_extract({pick}, {er}, 1)"
    lead = f"regexp_extract({pick}, {er}, 2)"
    frac = f"regexp_replace(regexp_extract({pick}, {er}, 3), '0+$', '')"
    e = f"CAST(regexp_extract({pick}, {er}, 4) AS INT)"
    digits = f"concat({lead}, {frac})"
    n = f"length({digits})"
    int_part = (f"(CASE WHEN {n} <= {e} + 1 THEN rpad({digits}, {e} + 1, '0') "
                f"ELSE substring({digits}, 1, {e} + 1) END)")
    frac_part = f"(CASE WHEN {n} <= {e} + 1 THEN '0' ELSE substring({digits}, {e} + 2) END)"
    positional_big = f"concat({sign}, {int_part}, '.', {frac_part})"
    positional_small = f"concat({sign}, '0.', repeat('0', -({e}) - 1), {digits})"
    mant = f"(CASE WHEN {frac} = '' THEN {lead} ELSE concat({lead}, '.', {frac}) END)"
    mag = f"CAST(abs({e}) AS STRING)"
    exp_txt = (f"concat(CASE WHEN {e} < 0 THEN '-' ELSE '+' END, "
               f"CASE WHEN abs({e}) < 10 THEN concat('0', {mag}) ELSE {mag} END)")
    scientific = f"concat({sign}, {mant}, 'e', {exp_txt})"
    return (f"(CASE WHEN {c} IS NULL THEN {lit_str(null_text)} WHEN isnan({c}) THEN 'nan' "
            f"WHEN {c} = {_INF} THEN 'inf' WHEN {c} = {_NINF} THEN '-inf' "
            f"WHEN {e} >= 0 AND {e} < 16 THEN {positional_big} "
            f"WHEN {e} < 0 AND {e} >= -4 THEN {positional_small} "
            f"ELSE {scientific} END)")


def with_py_str(df: DataFrame, specs: dict[str, tuple[str, str]], null_text: str = "nan") -> DataFrame:
    """Add ``out`` = Python ``f"{v}"`` text of column ``src`` for each ``out: (src, dtype)``.

    For tables of a few rows per team: doubles are formatted by Python itself in
    one Arrow pass (as SQL, the search for the shortest digits of several
    values outgrows generated code)."""
    doubles = {o: src for o, (src, t) in specs.items() if t in ("float", "double")}
    plain = [(o, f"coalesce(CAST({q(src)} AS STRING), {lit_str(null_text)})") for o, (src, _) in specs.items() if o not in doubles]
    df = with_columns(df, plain)
    if not doubles:
        return df
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def shown(v: pd.Series) -> pd.Series:
        return v.map(lambda x: null_text if x is None else repr(float(x)) if x == x else "nan").astype(object)

    return df.withColumns({o: shown(df[src].cast("double")) for o, src in doubles.items()})


# --- Column forms --------------------------------------------------------------

def py_strip(x) -> Column:
    return expr(py_strip_sql(sql_of(x)))


def py_int(x) -> Column:
    return expr(py_int_sql(sql_of(x)))


def py_float(x) -> Column:
    return expr(py_float_sql(sql_of(x)))


def first_word(x) -> Column:
    return expr(first_word_sql(sql_of(x)))


def py_fixed(x, digits: int) -> Column:
    return expr(py_fixed_sql(sql_of(x), digits))


def py_str_double(x, null_text: str = "nan") -> Column:
    """``str(float)`` as one expression (use ``with_py_str`` for many columns)."""
    s = sql_of(x)
    return expr(repr_layout_sql(s, repr_pick_sql(s), null_text))
