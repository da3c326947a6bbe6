"""Scans with explicit schemas.

CSV columns are found by name in the header and cast cell by cell (no inference
pass over the data); ``checked_csv`` counts the cells that do not fit on the way and
``land_csv`` sets their rows aside, in one pass over the files; ``csv_rejects`` counts them alone. The NaN
values pandas would treat as missing become NULL once, here (N14). File listings
never select ``content``, so the binary source only lists.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType,
)

from pitchside import presets
from pitchside.functions.numeric import nan_to_null_sql
from pitchside.functions.sql import lit_str, q
from pitchside.functions.text import parse_date_sql

_INT_MEASURES = {m for m, how in presets.TEAM_MEASURES.items() if how == "sum"}

TEAM_MATCH_SCHEMA = StructType(
    [StructField("date", StringType()), StructField("team", StringType())]
    + [StructField(m, IntegerType() if m in _INT_MEASURES else DoubleType())
       for m in presets.TEAM_MEASURES])

_PLAYER_METRICS = [m for ws in presets.WEIGHTS.values() for m in ws]
PLAYER_MATCH_SCHEMA = StructType(
    [StructField("year", IntegerType()), StructField("player_name", StringType()),
     StructField("team", StringType()), StructField(presets.POSITION_COL, StringType()),
     StructField(presets.MINUTES_COL, DoubleType())]
    + [StructField(m, DoubleType()) for m in dict.fromkeys(_PLAYER_METRICS)])

OCR_TOKEN_SCHEMA = StructType([
    StructField("image_id", StringType()), StructField("section", StringType()),
    StructField("seq", IntegerType()), StructField("x", DoubleType()), StructField("y", DoubleType()),
    StructField("text", StringType()), StructField("conf", DoubleType())])


def _nan_free(df: DataFrame) -> DataFrame:
    cols = [f"{nan_to_null_sql(q(f.name))} AS {q(f.name)}"
            if isinstance(f.dataType, (DoubleType, FloatType)) else q(f.name)
            for f in df.schema.fields]
    return df.selectExpr(*cols)


def _cast_sql(field: StructField) -> str:
    """A CSV cell as the field's type: counts may be written as floats ("3.0"), anything else unfit is NULL."""
    c = q(field.name)
    if isinstance(field.dataType, StringType):
        return c
    number = f"try_cast(btrim({c}) AS DOUBLE)"
    if isinstance(field.dataType, IntegerType):
        return f"CASE WHEN {number} = floor({number}) THEN try_cast({number} AS INT) END"
    return number


def _csv_cells(spark: SparkSession, path: str, schema: StructType, null_value: str | None) -> DataFrame:
    """The schema's columns as text, found by name in the header; other columns and any order are fine.

    The header is the first file's; files whose header differs from it fail when read."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    df = reader.csv(path)
    missing = [n for n in schema.names if n not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {', '.join(df.columns)}")
    return df.selectExpr(*[q(n) for n in schema.names])


def _read(spark: SparkSession, path: str, schema: StructType, fmt: str, null_value: str | None) -> DataFrame:
    if fmt == "csv":
        cells = _csv_cells(spark, path, schema, null_value)
        return cells.selectExpr(*[f"{_cast_sql(f)} AS {q(f.name)}" for f in schema.fields])
    return spark.read.schema(schema).format(fmt).load(path)


def csv_rejects(spark: SparkSession, path: str, schema: StructType, null_value: str | None = None,
                date_col: str | None = None) -> DataFrame:
    """``column, rejected``: per column of a CSV the cells with text that the reader turns into NULL
    (``NaN`` and blank cells are missing, not rejected); ``date_col`` counts unparsable dates."""
    cells = _csv_cells(spark, path, schema, null_value)
    counts = []
    for f in schema.fields:
        value = parse_date_sql(q(f.name)) if f.name == date_col else _cast_sql(f)
        counts.append(f"count_if(btrim({q(f.name)}) <> '' AND lower(btrim({q(f.name)})) <> 'nan' AND ({value}) IS NULL) AS {q(f.name)}")
    pairs = ", ".join(f"{lit_str(n)}, {q(n)}" for n in schema.names)
    return cells.selectExpr(*counts).selectExpr(f"stack({len(schema.names)}, {pairs}) AS (column, rejected)")


def _checked(spark: SparkSession, path: str, schema: StructType, null_value: str | None, date_col: str | None,
             observation: Observation) -> DataFrame:
    """Typed rows with ``bad`` (column -> text of the cells that do not fit; empty map: none), counted into ``observation`` on the way."""
    cells = _csv_cells(spark, path, schema, null_value)
    typed, marks = [], []
    for f in schema.fields:
        value = parse_date_sql(q(f.name)) if f.name == date_col else _cast_sql(f)
        typed.append(f"{nan_to_null_sql(value) if isinstance(f.dataType, DoubleType) else value} AS {q(f.name)}")
        unfit = f"btrim({q(f.name)}) <> '' AND lower(btrim({q(f.name)})) <> 'nan' AND ({value}) IS NULL"
        marks.append(f"named_struct('key', {lit_str(f.name)}, 'value', CASE WHEN {unfit} THEN {q(f.name)} END)")
    rows = cells.selectExpr(*typed, f"map_from_entries(filter(array({', '.join(marks)}), e -> e.value IS NOT NULL)) AS bad")
    counts = [F.expr(f"count_if(map_contains_key(bad, {lit_str(n)}))").alias(n) for n in schema.names]
    return rows.observe(observation, F.count(F.lit(1)).alias("rows"), F.expr("count_if(size(bad) > 0)").alias("rows with rejects"), *counts)


def checked_csv(spark: SparkSession, path: str, schema: StructType, null_value: str | None = None,
                date_col: str | None = None) -> tuple[DataFrame, Observation]:
    """S1, S2 with their rejects counted in the same pass: the typed rows with ``bad`` (column -> text of each cell that
    became NULL), and an observation that holds, after the first action on them, ``rows``, ``rows with rejects`` and the
    rejected cells of every column (``observation.get``). The counts equal ``csv_rejects``, which reads the files again."""
    observation = Observation(f"rejects-{uuid.uuid4().hex}")
    return _checked(spark, path, schema, null_value, date_col, observation), observation


def land_csv(spark: SparkSession, path: str, schema: StructType, out: str, null_value: str | None = None,
             date_col: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """CSV files into Parquet below ``out`` in one pass over them: (clean rows, quarantined rows with ``bad``, counts).

    Rows with a rejected cell go to the folder ``quarantined=true``; those without to ``quarantined=false``."""
    rows, observation = checked_csv(spark, path, schema, null_value, date_col)
    rows.withColumn("quarantined", F.expr("size(bad) > 0")).write.mode("overwrite").partitionBy("quarantined").parquet(out)
    landed = spark.read.schema(StructType([*rows.schema.fields, StructField("quarantined", BooleanType())])).parquet(out)
    return landed.where("NOT quarantined").drop("bad", "quarantined"), landed.where("quarantined").drop("quarantined"), observation.get


def read_team_matches(spark: SparkSession, path: str, fmt: str = "csv",
                      null_value: str | None = None) -> DataFrame:
    """S1 (+A1): one row per team per match; ``date`` parsed to a timestamp."""
    df = _nan_free(_read(spark, path, TEAM_MATCH_SCHEMA, fmt, null_value))
    return df.withColumn("date", F.expr(parse_date_sql("`date`")))


def read_player_matches(spark: SparkSession, path: str, fmt: str = "csv",
                        null_value: str | None = None) -> DataFrame:
    """One row per player per match; ``Position`` stays a string ('0' = unknown)."""
    return _nan_free(_read(spark, path, PLAYER_MATCH_SCHEMA, fmt, null_value))


def list_reports(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """S3: report files one folder below ``root``: ``path, modificationTime, length``.

    The suffix filter is case-sensitive and not recursive; ``content`` is never
    selected, so no file is read.
    """
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .load(f"{root.rstrip('/')}/*"))
    return df.select(F.regexp_replace("path", "^file:", "").alias("path"), "modificationTime", "length")


def read_images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """Spark ``image`` rows; unreadable files are dropped."""
    return (spark.read.format("image").option("dropInvalid", True)
            .option("pathGlobFilter", glob).load(path))


def checked_images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}") -> tuple[DataFrame, DataFrame, Observation]:
    """S4/S5 with unreadable files counted in the same pass: (image rows, origins of the unreadable files, observation of ``files``
    and ``unreadable`` after the first action on the image rows)."""
    every = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", glob).load(path)
    observation = Observation(f"images-{uuid.uuid4().hex}")
    seen = every.observe(observation, F.count(F.lit(1)).alias("files"), F.expr("count_if(image.height < 0)").alias("unreadable"))
    return seen.where("image.height >= 0"), every.where("image.height < 0").selectExpr("image.origin AS origin"), observation


def read_ocr_tokens(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The OCR detections as a token table (re-aimed input)."""
    return spark.read.schema(OCR_TOKEN_SCHEMA).format(fmt).load(path)


def explode_detections(df: DataFrame, detections: str = "detections",
                       keep: tuple[str, ...] = ("image_id", "section")) -> DataFrame:
    """S6, nested variant: ``array<struct<x, y, text, conf>>`` -> one row per
    detection with ``seq`` = detection order."""
    return (df.select(*keep, F.posexplode(detections).alias("seq", "__d"))
            .select(*keep, "seq", "__d.x", "__d.y", "__d.text", "__d.conf"))
