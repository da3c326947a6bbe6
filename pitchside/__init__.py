"""pitchside: match preparation (player scoring, matchups, OCR lanes and
formation, grid heatmaps, report catalog, scouting prompt) as Spark jobs."""

__version__ = "0.1.0"
