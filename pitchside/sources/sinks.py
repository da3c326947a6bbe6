"""Result sinks.

The reference writes PNG crops into ``<side>/<kind>`` folders and shows
figures; here the tables behind them are written as parquet. ``write_table`` writes
whole outputs (``overwrite``), so a re-run after a lost executor or a failed
job replaces partial output. ``write_incremental`` replaces only the partitions that
its rows fall into and notes them in a manifest once they are complete, so a
re-run for one team or one kind leaves the others as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions.sql import lit_str, q, run_sql

#: Folder below an incremental output that readers of the output skip, and the column that names the run of a row.
MANIFEST, RUN_COL = "_manifest", "run_id"


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Write the table that fed a figure (heatmap grid, lanes, pitch ...)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_incremental(df: DataFrame, path: str, partition_by: Sequence[str], run_id: str | None = None) -> str:
    """Replace the partitions of ``path`` that ``df`` has rows in (dynamic partition overwrite) and list them, with their
    rows, in the manifest. Returns the run's id.

    Partitions become visible when the whole write is committed; the manifest is written after that, from the run's own rows
    (only partition values and the narrow ``run_id`` column are read). A run that fails before leaves its partitions
    unlisted, and the next run writes them again."""
    spark, run = df.sparkSession, run_id or uuid.uuid4().hex
    if any(c.lower() == RUN_COL for c in df.columns):
        raise ValueError(f"the column {RUN_COL} is the sink's own")
    (df.withColumn(RUN_COL, F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
    keys = ", ".join(q(c) for c in partition_by)
    done = run_sql({"t": spark.read.parquet(path)}, f"SELECT {keys}, count(*) AS rows, {lit_str(run)} AS {RUN_COL}, current_timestamp() AS finished_at "
                                                  f"FROM {{t}} WHERE {RUN_COL} = {lit_str(run)} GROUP BY {keys}")
    done.write.mode("append").parquet(f"{path.rstrip('/')}/{MANIFEST}")
    return run


def finished_partitions(spark: SparkSession, path: str, partition_by: Sequence[str]) -> DataFrame:
    """The latest manifest line of every finished partition: ``partition_by..., rows, run_id, finished_at``."""
    keys = ", ".join(q(c) for c in partition_by)
    m = spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}")
    return run_sql({"m": m}, f"SELECT {keys}, max_by(struct(rows, {RUN_COL}, finished_at), finished_at) AS last FROM {{m}} GROUP BY {keys}").select(*partition_by, "last.*")


def unfinished(df: DataFrame, finished: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose partition is not among the ``finished`` ones: what a run that was cut short still has to write."""
    on = " AND ".join(f"CAST(d.{q(c)} AS STRING) <=> CAST(f.{q(c)} AS STRING)" for c in partition_by)
    return run_sql({"d": df, "f": finished}, f"SELECT d.* FROM {{d}} d LEFT ANTI JOIN {{f}} f ON {on}")


def write_crop_plan(plan: DataFrame, path: str, mode: str = "overwrite", incremental: bool = False) -> None:
    """The crop plan laid out like the reference's folders (team folder / side / kind when incremental, so that a re-run for
    one team keeps the others; else side / kind of one plan)."""
    if incremental:
        write_incremental(plan, path, ("folder", "side", "kind"))
    else:
        write_table(plan, path, mode, partition_by=("side", "kind"))


def write_player_table(matches: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("player_name", "team")) -> DataFrame:
    """The player-match rows as a table bucketed and sorted by ``keys``: aggregates, windows and joins on the keys need no
    shuffle when they read it (P5, P13, P15, P19). One file per bucket; choose ``buckets`` so that a bucket fits a task.

    Whole players lie in one bucket, so the layout suits keys without a hot one, as a player has a bounded number of matches."""
    spark = matches.sparkSession
    (matches.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return spark.table(table)
