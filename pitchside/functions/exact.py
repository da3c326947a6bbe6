"""Sums that do not depend on the order of their rows, and exact decimal labels of doubles.

``exact_mean``: a double is cut into chunks on one fixed binary grid (``CHUNKS`` chunks
of ``BITS`` bits above 2^``LOW``); each chunk is a whole number, so its sum is a long
accumulator that partial aggregation may add in any order. The chunk sums are carried
into one unique digit form before they become a double again. Equal multisets of values
therefore give bit-equal means, whatever the partitions or the shuffle did. Bits below
2^``LOW`` are rounded value by value. Values from 2^``TOP`` on, infinities and NaN are
added as doubles beside it, by the rules of IEEE.

``fixed_sql``: ``{x:.Nf}`` exactly, from the binary fraction of the double in whole-number
arithmetic (half to even on the true value, as Python does).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pitchside.functions.sql import dbl, q, run_sql

#: Lowest bit kept, bits of a chunk, chunks; magnitudes from 2^TOP on are not cut.
LOW, BITS, CHUNKS = -90, 30, 6
TOP = LOW + BITS * CHUNKS - 1


def _pow2(e: int) -> str:
    return dbl(2.0 ** e)


def chunk_sums_sql(x: str, name: str) -> list[tuple[str, str]]:
    """Aggregates (expression, name) from which ``exact_mean_sql`` forms the mean of the column ``x`` (SQL text)."""
    inside = f"({x}) IS NOT NULL AND abs({x}) < {_pow2(TOP)}"
    parts = []
    for j in range(CHUNKS):
        scale = -(LOW + BITS * j)
        chunk = f"rint(({x}) * {_pow2(scale)}) - rint(({x}) * {_pow2(scale - BITS)}) * {_pow2(BITS)}"
        parts.append((f"coalesce(sum(CASE WHEN {inside} THEN CAST({chunk} AS BIGINT) END), 0L)", f"{name}__{j}"))
    parts.append((f"sum(CASE WHEN {inside} THEN 0D ELSE {x} END)", f"{name}__big"))
    parts.append((f"count({x})", f"{name}__n"))
    return parts


def _digits(sums: Sequence[str]) -> tuple[list[str], str]:
    """The chunk sums as digits 0 .. 2^BITS - 1 with one whole number above them."""
    out, carry = [], "0L"
    for s in sums[:-1]:
        total = f"({s} + {carry})"
        out.append(f"({total} & {(1 << BITS) - 1}L)")
        carry = f"shiftright({total}, {BITS})"
    return out, f"({sums[-1]} + {carry})"


def _value(sums: Sequence[str]) -> tuple[str, str]:
    low, top = _digits(sums)
    total = "0D"
    for d in [*low, top]:
        total = f"({total} * {_pow2(-BITS)} + CAST({d} AS DOUBLE))"
    return top, f"({total} * {_pow2(LOW + BITS * (CHUNKS - 1))})"


def exact_mean_sql(name: str) -> str:
    """The mean from the aggregates of ``chunk_sums_sql``; NULL without values."""
    sums = [q(f"{name}__{j}") for j in range(CHUNKS)]
    top, up = _value(sums)
    _, down = _value([f"(-{s})" for s in sums])
    # a negative sum is formed from its magnitude, so that no digits cancel
    total = f"CASE WHEN {top} < 0 THEN -{down} ELSE {up} END"
    return f"(({total} + coalesce({q(name + '__big')}, 0D)) / nullif({q(name + '__n')}, 0))"


def exact_means(df: DataFrame, keys: Sequence[str], values: Sequence[tuple[str, str]], where: str = "true") -> DataFrame:
    """``keys..., <name>...``: order-free means of ``values`` (name, SQL expression) per key, in one aggregate."""
    k = ", ".join(q(c) for c in keys)
    cols = ", ".join(f"{e} AS {q(f'__v{i}')}" for i, (_, e) in enumerate(values))
    sums = ", ".join(f"{e} AS {q(n)}" for i in range(len(values)) for e, n in chunk_sums_sql(q(f"__v{i}"), f"__v{i}"))
    out = ", ".join(f"{exact_mean_sql(f'__v{i}')} AS {q(n)}" for i, (n, _) in enumerate(values))
    return run_sql({"src": df}, f"SELECT {k}, {out} FROM (SELECT {k}, {sums} FROM (SELECT {k}, {cols} FROM {{src}} WHERE {where}) GROUP BY {k})")


def fixed_sql(x: str, digits: int) -> str:
    """``{x:.Nf}`` of a finite double, N from 0 to 3, also the sign of a negative value that rounds to zero.

    Below 2^53 the fraction is 52 binary places and a remainder below them. The places times 10^N are a whole number of
    62 bits at most; its upper part are the decimals, and its lower part with the remainder decides the rounding. From 2^53 on
    doubles are whole numbers; those of 2^63 and more show their shortest digits, filled up with zeros."""
    if not 0 <= digits <= 3:
        raise ValueError("0 to 3 digits")
    ten, places = 10 ** digits, 52
    a = f"abs(CAST({x} AS DOUBLE))"
    scaled = f"(({a} - floor({a})) * {_pow2(places)})"
    # what lies below the places, times 10^N: a whole number to add, and whether something is left
    below = f"(({scaled} - floor({scaled})) * {ten}D)"
    product = f"(floor({scaled}) * {ten}L + floor({below}))"
    decimals, rest = f"shiftright({product}, {places})", f"({product} & {(1 << places) - 1}L)"
    n = f"(floor({a}) * {ten}L + {decimals})"
    half = f"{1 << (places - 1)}L"
    n = f"({n} + CASE WHEN {rest} > {half} OR ({rest} = {half} AND ({below} > floor({below}) OR {n} % 2 = 1)) THEN 1L ELSE 0L END)"
    text = f"CAST({n} AS STRING)" if digits == 0 else f"concat(CAST({n} div {ten}L AS STRING), '.', lpad(CAST({n} % {ten}L AS STRING), {digits}, '0'))"
    sign = f"CASE WHEN startswith(CAST(CAST({x} AS DOUBLE) AS STRING), '-') THEN '-' ELSE '' END"
    zeros = "." + "0" * digits if digits else ""
    return (f"concat({sign}, CASE WHEN {a} < {_pow2(53)} THEN {text} WHEN {a} < {_pow2(63)} THEN concat(CAST(CAST({a} AS BIGINT) AS STRING), '{zeros}') "
            f"ELSE format_string('%.{digits}f', {a}) END)")
