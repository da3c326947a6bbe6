"""Scouting prompt text for every team at once.

The text is a fixed template; values print the way Python prints pandas
cells (integers as digits, floats as ``repr``, missing as ``nan``). The three
inputs are one row per team and are joined on the team column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.sql import lit_str, q
from pitchside.functions.text import with_py_str

_IND = "    "


def scouting_prompt(summary: DataFrame, lanes: DataFrame, formation: DataFrame,
                    team_col: str = "team", formation_col: str = "Total") -> DataFrame:
    """-> ``team, system_message, prompt``.

    ``lanes`` carries ``{left,mid,right}_attempts`` and ``_XG`` (the lane
    profile means); ``formation`` carries the ``Total`` mean. A team missing in
    either input keeps ``nan`` there (the reference fails instead).
    """
    lanes_cols = [f"{lane}_{k}" for lane in presets.LANES for k in ("attempts", "XG")]
    j = (summary.join(lanes.select(team_col, *lanes_cols), team_col, "left")
         .join(formation.selectExpr(q(team_col), f"{q(formation_col)} AS __total"), team_col, "left"))
    needed = [col for _, col, _ in presets.PROMPT_STAT_LINES] + lanes_cols + ["__total"]
    j = with_py_str(j, {f"__s_{c}": (c, j.schema[c].dataType.simpleString()) for c in dict.fromkeys(needed)})

    def _val(_df, col: str) -> str:
        return q(f"__s_{col}")

    def lit(s: str) -> str:
        return lit_str(s)

    stats = [lit("\n")]
    for label, col, suffix in presets.PROMPT_STAT_LINES:
        stats += [lit(f"{_IND}- {label}: "), _val(j, col), lit(f"{suffix}\n")]
    stats.append(lit(_IND))

    attack = [lit(f"\n{_IND}Attack Side Breakdown:\n")]
    for label, lane in presets.PROMPT_LANE_LINES:
        attack += [lit(f"{_IND}- {label}: "), _val(j, f"{lane}_attempts"),
                   lit(" attempts, xG: "), _val(j, f"{lane}_XG"), lit("\n")]
    attack.append(lit(_IND))

    form = [lit(f"\n{_IND}Average Formation Possession by Time Period:\n{_IND}- Total: "),
            _val(j, "__total"), lit(f"%\n{_IND}")]

    parts = ([lit(f"\n{_IND}{presets.PROMPT_INTRO}\n\n{_IND}Team Stats:\n{_IND}")] + stats
             + [lit(f"\n\n{_IND}Attack Side Breakdown:\n{_IND}")] + attack
             + [lit(f"\n\n{_IND}Average Formation Possession:\n{_IND}")] + form
             + [lit(f"\n\n{_IND}{presets.PROMPT_OUTRO}\n{_IND}")])
    return j.selectExpr(q(team_col), f"{lit(presets.SYSTEM_MESSAGE)} AS system_message",
                        f"concat({', '.join(parts)}) AS prompt")
