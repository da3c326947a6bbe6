"""Streaming forms of the two accumulating jobs.

The reference re-reads whole folders each time. Both accumulations are plain
grouped sums, so the same operators run unchanged on a streaming DataFrame:
new report cells (``image_cells`` / ``marked_cells`` output written as
parquet) or new match rows arrive, and Spark keeps the per-cell / per-team
running totals in its state store. The checkpoint goes below the session's
``spark.checkpoint.dir`` (a shared folder on a cluster), so a restarted query
resumes from its last committed batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pitchside import presets
from pitchside.operators.grid import accumulate
from pitchside.operators.summary import season_summary
from pitchside.session import ensure_checkpoint_dir

CELL_TABLE_SCHEMA = ("origin string, side string, grid_rows int, grid_cols int, cell_row int, "
                     "cell_col int, marked int, flag int")


def running_heatmap(cells: DataFrame, by: Sequence[str] = ("side",)) -> DataFrame:
    """G5 on a stream of cell rows: hits per (group, cell) so far."""
    return accumulate(cells, by)


def running_season_summary(matches: DataFrame, measures: Mapping[str, str] = presets.TEAM_MEASURES,
                           year: int | None = presets.DEFAULT_SEASON) -> DataFrame:
    """A1-A5 on a stream of team-match rows."""
    return season_summary(matches, measures, year)


def start_complete(df: DataFrame, name: str, sink: str = "parquet", path: str | None = None,
                   available_now: bool = True) -> StreamingQuery:
    """Start an aggregate stream in ``complete`` mode into files at ``path`` (the
    totals are small: one row per group and cell, or per team). ``sink="memory"``
    keeps the table ``name`` in the driver and is for tests only."""
    if sink != "memory" and not path:
        raise ValueError("a file sink needs a path")
    spark = df.sparkSession
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    w = df.writeStream.outputMode("complete").option("checkpointLocation", ckpt)
    if sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        # file sinks only append; every complete-mode batch holds the whole
        # result, so each batch replaces the table (idempotent on retry).
        def _replace(batch: DataFrame, _batch_id: int) -> None:
            batch.write.mode("overwrite").format(sink).save(path)
        w = w.foreachBatch(_replace)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
