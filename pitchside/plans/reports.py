"""Report jobs end to end: heatmaps by side, attack lanes of own and rival teams, the scouting prompt.

Each takes the tables that its report produces (image rows, OCR tokens, team
matches) and gives the tables behind the figures; all teams at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.sql import q
from pitchside.operators.formation import formation_profile, formation_rows
from pitchside.operators.grid import accumulate, image_cells, scale_grid
from pitchside.operators.integral import image_integrals, integral_cells
from pitchside.operators.lanes import attack_lanes, lane_profile
from pitchside.operators.prompt import scouting_prompt
from pitchside.operators.summary import season_summary
from pitchside.session import ensure_checkpoint_dir


def heatmaps(images: DataFrame, by: Sequence[str] = ("side",), method: str = "log",
             cell: tuple[int, int] = presets.GRID_CELL, fraction: float = presets.GRID_FRACTION) -> DataFrame:
    """Shot maps as ``image`` rows with the ``by`` columns -> scaled grid per group."""
    cells = image_cells(images, cell, fraction, keep=by)
    return scale_grid(accumulate(cells, by, dense=True), method, by)


def heatmaps_by_setting(images: DataFrame, settings: Sequence[tuple], by: Sequence[str] = ("side",), table: DataFrame | None = None) -> DataFrame:
    """G1-G5 for several cell sizes, fractions and crops from one decode: ``setting, by..., cell_row, cell_col, hits``.

    ``table``: summed-area tables written earlier; without it they are kept in the checkpoint folder first."""
    if table is None:
        ensure_checkpoint_dir(images.sparkSession)
        table = image_integrals(images, keep=by).checkpoint(eager=True)
    return accumulate(integral_cells(table, settings, keep=by), ["setting", *by], dense=True)


def lane_profiles(tokens: DataFrame, images: DataFrame, by: Sequence[str] = ("team", "side"),
                  image_col: str = "image_id") -> DataFrame:
    """Tokens of lane crops and one row per image with the ``by`` columns -> one profile per group."""
    lanes = attack_lanes(tokens, images=images.select(image_col), image_col=image_col)
    meta = images.select(image_col, *by).dropDuplicates([image_col])
    return lane_profile(lanes.join(meta, image_col), by)


def prompts(matches: DataFrame, lanes: DataFrame, table_tokens: DataFrame, line_tokens: DataFrame,
            year: int | None = presets.DEFAULT_SEASON, team_col: str = "team", side: str | None = None) -> DataFrame:
    """Season summary, lane profile and formation profile of every team -> its scouting prompt.

    ``lanes``: one profile per team, or per team and ``side`` (``side`` picks one).
    ``table_tokens`` name the team of their image in ``team_col``."""
    own = lanes if side is None else lanes.filter(f"side = '{side}'")
    tokens = table_tokens.withColumnRenamed(team_col, "__team")
    rows = formation_rows(tokens, line_tokens, select="name", team_col="__team", carry=["__team"])
    formation = formation_profile(rows, by=["__team"]).selectExpr(f"__team AS {q(team_col)}", "Total")
    return scouting_prompt(season_summary(matches, year=year, team_col=team_col), own, formation, team_col)
