"""Incremental forms of the accumulating jobs (Structured Streaming)."""

from pitchside.streaming.incremental import (  # noqa: F401
    CELL_TABLE_SCHEMA, running_heatmap, running_season_summary, start_complete,
)
