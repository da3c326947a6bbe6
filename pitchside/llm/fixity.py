"""Operator 4: Merkle fixity audit of archive replicas.

Every record of a replica is hashed (SHA-256) into a leaf at its place (file,
offset). Ordered offset ranges are hashed into nodes, ranges of ranges above
them, up to one hash per file, and files by hash prefix up to one root. Replicas
are compared from the root down: only children of branches that differ are
compared on the next level, so equal replicas cost one comparison and damage
costs the path to it.

A range is a fixed span of bytes, ``FANOUT`` times wider on each level, so a
missing or longer record does not shift the ranges behind it. A node's input is
its ordered children: at the lowest level the places within ``SPAN`` bytes, then at
most ``FANOUT`` ranges, above a file the files of one hash prefix.

Edge cases: a null payload is hashed as absent, unlike an empty one; rows with a
null file or offset have no place and are left out (``unplaced`` counts them);
several rows at one place are one leaf of their order-free combined hash, and
their number counts; extra columns are ignored; two empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import written

#: Bytes of the lowest ranges, children of a node, levels of wider ranges (4 MB, 1 GB, 256 GB), and hex digits of the
#: hash of the file's name that group files on the levels above, up to the root.
SPAN, FANOUT, LEVELS, FILE_DIGITS = 1 << 14, 256, 3, (3, 0)


def leaves(records: DataFrame) -> DataFrame:
    """(side, file, offset, n, length, digest) per place of ``records`` (side, file, offset, payload: string or binary)."""
    payload = F.col("payload").cast("binary")
    r = records.where("file IS NOT NULL AND offset IS NOT NULL").select(
        "side", "file", F.col("offset").cast("long").alias("offset"), F.length(payload).cast("long").alias("length"),
        F.coalesce(F.sha2(payload, 256), F.lit("absent")).alias("digest"))
    # rows at one place are combined without gathering them
    r = r.groupBy("side", "file", "offset").agg(
        F.count("*").alias("n"), F.max("length").alias("length"), F.min("digest").alias("lo"), F.max("digest").alias("hi"),
        F.bit_xor(F.xxhash64("digest")).alias("x"), F.sum(F.crc32(F.col("digest").cast("binary"))).alias("s"))
    combined = F.sha2(F.concat_ws("|", "n", "lo", "hi", "x", "s"), 256)
    return r.select("side", "file", "offset", "n", "length", F.when(F.col("n") == 1, F.col("lo")).otherwise(combined).alias("digest"))


def unplaced(records: DataFrame) -> DataFrame:
    """One row: the number of records without a place."""
    return records.agg(F.count_if(F.col("file").isNull() | F.col("offset").isNull()).alias("unplaced"))


def _parents() -> list[tuple[Column, Column]]:
    """(name, node) of the parent of a node, for each level from the lowest ranges up to the children of the root."""
    within = (F.col("name"), F.expr(f"node div {FANOUT}"))
    files = [(F.sha2("name", 256).substr(1, FILE_DIGITS[0]), F.lit(0).cast("long"))]
    return [within] * LEVELS + files + [(F.col("name").substr(1, d), F.lit(0).cast("long")) for d in FILE_DIGITS[1:]]


def _hashed(children: DataFrame, at: Column) -> DataFrame:
    """One node per (side, name, node): SHA-256 of its children's places and hashes in order."""
    items = F.sort_array(F.collect_list(F.struct(at.alias("at"), "hash")))
    text = F.concat_ws(",", F.transform("c", lambda x: F.concat_ws("=", x["at"], x["hash"])))
    return children.groupBy("side", "up_name", "up_node").agg(items.alias("c")).select(
        "side", F.col("up_name").alias("name"), F.col("up_node").alias("node"), F.sha2(text, 256).alias("hash"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels (side, name, node, hash) from the lowest ranges (name: the file, node: number of the range) up to the root."""
    low = leaf.select("side", F.col("file").cast("string").alias("up_name"), F.expr(f"offset div {SPAN}").alias("up_node"),
                      "offset", F.concat_ws("/", "digest", "n").alias("hash"))
    levels = [written(_hashed(low, F.lpad(F.col("offset").cast("string"), 20, "0")), "op4-ranges")]
    for name, node in _parents():
        up = levels[-1].withColumn("up_name", name).withColumn("up_node", node)
        levels.append(_hashed(up, F.concat_ws(":", "name", F.lpad(F.col("node").cast("string"), 20, "0"))))
    return levels


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per place where two replicas (file, offset, payload) differ: file, offset, status (corrupt, missing: only
    in ``a``, extra: only in ``b``), length_a, length_b, digest_a, digest_b."""
    records = [x.select(F.lit(s).alias("side"), "file", "offset", "payload") for s, x in (("a", a), ("b", b))]
    leaf = written(leaves(records[0].unionAll(records[1])), "op4-leaves")
    levels, parents = tree(leaf), _parents()
    branch = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth]
        if branch is not None:
            name, node = parents[depth]
            nodes = nodes.withColumn("_n", name).withColumn("_k", node).join(branch.select(F.col("name").alias("_n"), F.col("node").alias("_k")), ["_n", "_k"], "left_semi")
        differ = nodes.groupBy("name", "node").agg(F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("n <> 2 OR lo <> hi")
        branch = written(differ.select("name", "node"), "op4-branch")
        if branch.isEmpty():
            break
    on = (F.col("file").cast("string") == F.col("name")) & (F.expr(f"offset div {SPAN}") == F.col("node"))
    place = leaf.join(branch, on, "left_semi").groupBy("file", "offset")
    of = lambda col, side: F.max(F.when(F.col("side") == side, F.col(col))).alias(f"{col}_{side}")
    both = place.agg(*[of(c, s) for c in ("n", "length", "digest") for s in ("a", "b")]).where("NOT (digest_a <=> digest_b AND n_a <=> n_b)")
    status = F.when(F.col("n_b").isNull(), "missing").when(F.col("n_a").isNull(), "extra").otherwise("corrupt")
    return both.select("file", "offset", status.alias("status"), "length_a", "length_b", "digest_a", "digest_b")
