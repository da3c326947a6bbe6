"""Readers and writers."""

from pitchside.sources.readers import (  # noqa: F401
    PLAYER_MATCH_SCHEMA, TEAM_MATCH_SCHEMA, OCR_TOKEN_SCHEMA,
    checked_csv, checked_images, csv_rejects, explode_detections, land_csv, list_reports, read_images, read_ocr_tokens, read_player_matches,
    read_team_matches,
)
from pitchside.sources.pdf import read_page_counts  # noqa: F401
from pitchside.sources.sinks import (  # noqa: F401
    finished_partitions, unfinished, write_crop_plan, write_incremental, write_player_table, write_table,
)
