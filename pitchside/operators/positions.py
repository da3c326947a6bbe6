"""Primary (most-played) category per entity.

``split -> explode -> sum(weight) per (keys, raw code) -> arg-max -> map``.
Each step is a built-in expression or a hash aggregate with partial
aggregation; the arg-max is a ``row_number`` over the (small) per-key groups of
distinct codes, never over raw rows. The canonical map is a literal map (no
join at all).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.sql import lit_str, q, run_sql


def invert_groups(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """{canonical: [raw codes]} -> {raw code: canonical}."""
    return {code: canon for canon, codes in groups.items() for code in codes}


def map_lookup_sql(x: str, mapping: Mapping[str, str]) -> str:
    """Literal-map lookup; an unmapped or NULL key gives NULL."""
    if not mapping:
        return "CAST(NULL AS STRING)"
    pairs = ", ".join(f"{lit_str(k)}, {lit_str(v)}" for k, v in mapping.items())
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE try_element_at(map({pairs}), {x}) END)"


def _split_pattern(sep: str) -> str:
    return sep if re.fullmatch(r"[A-Za-z0-9 ,;:_-]*", sep) else "\\Q" + sep + "\\E"


def _category_steps(keys: Sequence[str], list_col: str, weight: str, sep: str,
                    unknown: str) -> list[tuple[str, str]]:
    k = ", ".join(q(c) for c in keys)
    return [
        ("kept", f"SELECT * FROM {{src}} WHERE NOT ({q(list_col)} <=> {lit_str(unknown)})"),
        ("per_code", f"""SELECT {k}, code, coalesce(sum(__w), 0D) AS minutes FROM (
  SELECT {k}, explode_outer(split({q(list_col)}, {lit_str(_split_pattern(sep))}, -1)) AS code,
         CAST({q(weight)} AS DOUBLE) AS __w FROM {{kept}})
GROUP BY {k}, code"""),
    ]


def raw_category_minutes(df: DataFrame, keys: Sequence[str] = ("player_name", "team"),
                         list_col: str = presets.POSITION_COL, weight: str = presets.MINUTES_COL,
                         sep: str = presets.POSITION_SEP, unknown: str = presets.POSITION_UNKNOWN) -> DataFrame:
    """Total weight per (keys, raw code).

    Rows whose list is exactly the ``unknown`` sentinel are dropped; a NULL
    list stays (N5) but contributes no code. Every listed code is credited
    with the full weight. Keys or code NULL are not grouped (N4).
    """
    named = " AND ".join(f"{q(c)} IS NOT NULL" for c in [*keys, "code"])
    return run_sql({"src": df}, f"SELECT * FROM {{per_code}} WHERE {named}",
                   _category_steps(keys, list_col, weight, sep, unknown))


def primary_category(df: DataFrame, keys: Sequence[str] = ("player_name", "team"),
                     list_col: str = presets.POSITION_COL, weight: str = presets.MINUTES_COL,
                     mapping: Mapping[str, str] | None = None,
                     sep: str = presets.POSITION_SEP, unknown: str = presets.POSITION_UNKNOWN,
                     out: str = "Most_played_position") -> DataFrame:
    """One row per distinct key of the kept rows, with the mapped arg-max code.

    Raw codes compete before canonicalisation (P13); ties go to the
    alphabetically first code (N7); unmapped codes become NULL (P17); a key
    whose rows all have a NULL list keeps a NULL category (P15); a key with only
    sentinel rows vanishes.
    """
    mapping = invert_groups(presets.POSITION_GROUPS) if mapping is None else mapping
    k = ", ".join(q(c) for c in keys)
    steps = _category_steps(keys, list_col, weight, sep, unknown) + [
        # a NULL code keeps its key but never wins
        ("best", f"""SELECT {k}, code FROM (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY code IS NULL, minutes DESC, code ASC) AS __rn FROM {{per_code}})
WHERE __rn = 1"""),
    ]
    # a row without a full key keeps no category, as it joins nothing
    named = " AND ".join(f"{q(c)} IS NOT NULL" for c in keys)
    sql = f"SELECT {k}, CASE WHEN {named} THEN {map_lookup_sql('code', mapping)} END AS {q(out)} FROM {{best}}"
    return run_sql({"src": df}, sql, steps)
