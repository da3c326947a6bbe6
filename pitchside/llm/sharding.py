"""Operator 6: proportional stratified interleaving (native).

Rows are shuffled by a seeded hash and ranked within their source; the
fractional rank (rank - 1/2) / (rows of the source) puts every source evenly
along [0, 1). Sorted by it and cut into equal runs, every shard has each source
in its share of the whole, within a row or so. The law is ``rows``: shard sizes
in rows differ by one at most.

Both ranks are made in two levels, so no source and no sort is one task: rows are
counted in buckets of the hash (or of the fraction), the buckets' counts are
summed up in order, and rows are numbered within their bucket only.

Edge cases: a null source is a source of its own; a null or empty text has size
16; ties and repeated rows are ordered by all their columns; rows that share an id
(or have none) are dealt by their other columns where they are more than a bucket, and
equal rows, which are interchangeable, by a written row number; all columns are
carried under their names, texts of any length as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchside.llm.common import written

#: Rows of a bucket that are aimed at, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], rank: str, size: str) -> DataFrame:
    """``df`` with the row number from 1 within ``group`` along (bucket, order), and the rows of the group."""
    df = df.withColumn("_bucket", bucket)
    count = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    key = W.partitionBy(*group)
    below = F.sum("_n").over(key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    count = count.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"),
                         F.coalesce(below, F.lit(0)).alias("_below"), F.sum("_n").over(key).alias(size))
    on = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order))
    df = df.withColumn("_own", own).join(count, on)
    return df.withColumn(rank, F.col("_own") + F.col("_below")).drop("_bucket", "_own", "_below", "_b", *[f"_g{i}" for i in range(len(group))])


def interleaved(df: DataFrame, shards: int = 40, source: str = "source", key: str = "doc_id", seed: int = 20) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard); columns of these names are replaced."""
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # columns by number, so that no name can clash with a helper's; rows numbered once, as equal ones are told apart by it alone
    at = {c: f"c{i}" for i, c in enumerate(keep)}
    rows = written(df.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()], F.monotonically_increasing_id().alias("_row")), "op6-rows")
    total = rows.count()
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    rows = rows.select("*", F.xxhash64(*at.values()).alias("_all"), F.xxhash64(F.lit(seed), F.col(at[key])).alias("_seeded"), F.col(at[source]).alias("_source"))
    # rows without id, or of one id, are parted by their other columns; more than a bucket of equal rows by their numbers (at most
    # one such hash in BUCKET_ROWS rows, so the list is broadcast)
    same = rows.groupBy(F.col("_seeded").alias("_s")).agg(F.count("*").alias("_n")).where(f"_n > {BUCKET_ROWS}")
    rows = rows.join(F.broadcast(same), F.col("_seeded") == F.col("_s"), "left")
    rows = rows.withColumn("_hash", F.when(F.col("_n").isNull(), F.col("_seeded")).otherwise(F.xxhash64(F.lit(seed), "_all"))).drop("_s", "_n")
    equal = rows.groupBy(F.col("_hash").alias("_s")).agg(F.count("*").alias("_n")).where(f"_n > {BUCKET_ROWS}")
    rows = rows.join(F.broadcast(equal), F.col("_hash") == F.col("_s"), "left")
    rows = rows.withColumn("_hash", F.when(F.col("_n").isNull(), F.col("_hash")).otherwise(F.xxhash64(F.lit(seed), "_hash", "_row"))).drop("_s", "_n")
    # buckets cut the range of the hash, then that of the fraction, evenly
    part = F.floor((F.col("_hash") / F.lit(2.0 ** 64) + 0.5) * buckets)
    rows = _ranked(rows, ["_source"], part, [F.col("_hash"), F.col(at[key]), F.col("_all"), F.col("_row")], "_rank", "_size")
    rows = rows.withColumn("_at", (F.col("_rank") - 0.5) / F.col("_size")).drop("_rank", "_size")
    rows = _ranked(rows, [], F.floor(F.col("_at") * buckets), [F.col("_at"), F.col("_hash"), F.col("_source"), F.col("_all"), F.col("_row")], "_place", "_size")
    # shard s holds the places from ceil(s * total / shards) on
    rows = rows.withColumn("shard", F.expr(f"cast((_place - 1) * {shards} div {max(total, 1)} as int)"))
    return rows.select(*[F.col(n).alias(c) for c, n in at.items()], "shard", F.expr(f"_place - 1 - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"))
