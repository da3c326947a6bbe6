"""8-bit colour conversions as integer SQL arithmetic.

The conversions follow OpenCV's published 8-bit fixed-point definitions:
gray = (4899 R + 9617 G + 1868 B + 2^13) >> 14, and for HSV a 12-bit
fixed-point reciprocal table for S and H, H in 0..179.
"""

from __future__ import annotations

from pyspark.sql import Column

from pitchside.functions.sql import expr, sql_of

# fixed values: BT.601 luma in 14-bit fixed point, 12-bit HSV tables, hue range
R2Y, G2Y, B2Y, YUV_SHIFT = 4899, 9617, 1868, 14
HSV_SHIFT = 12
HUE_RANGE = 180


def gray_sql(b: str, g: str, r: str) -> str:
    """``cvtColor(BGR2GRAY)`` on 8-bit channels."""
    return (f"shiftright(CAST({r} AS INT) * {R2Y} + CAST({g} AS INT) * {G2Y} + CAST({b} AS INT) * {B2Y} "
            f"+ {1 << (YUV_SHIFT - 1)}, {YUV_SHIFT})")


def band_mask_sql(gray: str, lo: int = 70, hi: int = 255) -> str:
    """1 when ``gray >= hi`` or ``gray <= lo`` (both bounds inclusive), else 0."""
    return f"CAST(({gray} >= {hi} OR {gray} <= {lo}) AS INT)"


def hsv_sql(b: str, g: str, r: str) -> tuple[str, str, str]:
    """``cvtColor(BGR2HSV)`` on 8-bit channels -> (h, s, v) SQL texts."""
    b, g, r = (f"CAST({c} AS INT)" for c in (b, g, r))
    v = f"greatest({r}, {g}, {b})"
    diff = f"({v} - least({r}, {g}, {b}))"
    one, half = 1 << HSV_SHIFT, 1 << (HSV_SHIFT - 1)
    sdiv = f"(CASE WHEN {v} = 0 THEN 0 ELSE CAST(floor({255.0 * one!r}D / {v} + 0.5D) AS INT) END)"
    s = f"shiftright({diff} * {sdiv} + {half}, {HSV_SHIFT})"
    hraw = f"(CASE WHEN {v} = {r} THEN {g} - {b} WHEN {v} = {g} THEN {b} - {r} + 2 * {diff} ELSE {r} - {g} + 4 * {diff} END)"
    hdiv = (f"(CASE WHEN {diff} = 0 THEN 0 ELSE CAST(floor({float(HUE_RANGE * one)!r}D / ({diff} * 6) + 0.5D) "
            f"AS INT) END)")
    h0 = f"shiftright({hraw} * {hdiv} + {half}, {HSV_SHIFT})"
    h = f"(CASE WHEN {h0} < 0 THEN {h0} + {HUE_RANGE} ELSE {h0} END)"
    return h, s, v


def in_hsv_range_sql(h: str, s: str, v: str, lower, upper) -> str:
    """``inRange(hsv, lower, upper)`` with inclusive bounds."""
    return (f"({h} BETWEEN {lower[0]} AND {upper[0]} AND {s} BETWEEN {lower[1]} AND {upper[1]} "
            f"AND {v} BETWEEN {lower[2]} AND {upper[2]})")


# --- Column forms --------------------------------------------------------------

def hsv_from_bgr(b, g, r) -> Column:
    """-> struct<h, s, v>."""
    h, s, v = hsv_sql(sql_of(b), sql_of(g), sql_of(r))
    return expr(f"named_struct('h', {h}, 's', {s}, 'v', {v})")
