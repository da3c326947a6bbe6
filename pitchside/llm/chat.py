"""Operator 1: multi-party perspective rotation (native).

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant, all others as named users, and a loss mask on the
assistant's turns. System turns are instructions to all: rendered in every
perspective, never trained on, and not a participant.

The rendering is a table of segments in order, one per perspective and turn, with
its text, its character range in the rendered dialogue, and the trained range
within it. A rendered dialogue is the concatenation of its segments, so a
conversation of any length is rendered without gathering it in one row or task:
segments are dealt by ranges of (conversation, perspective, turn), summed within
a range, and the ranges' sums of a dialogue are added up in order. The result has
turns times participants rows, which is what the rotation asks for.

Edge cases: rows with a null conversation id are one conversation; a null or
empty role is the speaker "unknown"; a null text is empty; a null turn comes
first; turns that tie are ordered by speaker and text, equal rows are repeated
turns; a conversation of system turns only has no perspective and no rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchside.llm.common import written

#: Speaker of instructions, and of turns without one.
SYSTEM, UNKNOWN = "system", "unknown"
#: A segment is the head (with the speaker's name for a named user), the text and the end mark.
HEAD, NAMED, END = "<|im_start|>{}\n", "<|im_start|>user name={}\n", "<|im_end|>\n"


def rotated(turns: DataFrame) -> DataFrame:
    """Per conversation, participant and turn of ``turns`` (conv_id, turn, role, text): conv_id, perspective, seq (place
    of the turn from 0), turn, speaker, role (system, user, assistant), segment, start, stop, train_start, train_stop.

    start and stop are character offsets in the rendered dialogue; train_start and train_stop those of the assistant's
    text with its end mark, null where nothing is trained."""
    t = turns.select("conv_id", "turn", F.coalesce(F.nullif("role", F.lit("")), F.lit(UNKNOWN)).alias("speaker"),
                     F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    who = t.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    t = t.join(who, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    t = t.withColumn("role", F.expr(f"CASE speaker WHEN '{SYSTEM}' THEN 'system' WHEN perspective THEN 'assistant' ELSE 'user' END"))
    # sizes are enough for the offsets; a segment is put together once its place is known
    name = F.when(F.col("role") == "user", F.length("speaker") + len(NAMED.format(""))).otherwise(F.length("role") + len(HEAD.format("")))
    t = t.withColumn("size", (name + F.length("text") + len(END)).cast("long"))
    # ranges of the dialogue, numbered in order
    order = ["turn", "speaker", "text", "_row"]
    t = t.repartitionByRange("conv_id", "perspective", *order).withColumn("_part", F.spark_partition_id())
    # written, as the numbers must be the same wherever they are used: each range shuffle samples its bounds anew
    t = written(t, "op1-ranges")
    by = ["conv_id", "perspective"]
    inner = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = t.groupBy(*by, "_part").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_s"), F.col("_part").alias("_q"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("_c0"))
    t = t.withColumn("_n1", F.count("*").over(inner)).withColumn("_c1", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    t = t.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_s")) & (F.col("_part") == F.col("_q")))
    t = t.withColumn("start", F.col("_c0") + F.col("_c1"))
    head = F.when(F.col("role") == "user", F.format_string(NAMED.replace("{}", "%s"), "speaker")).otherwise(F.format_string(HEAD.replace("{}", "%s"), "role"))
    t = t.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(END)))
    trained = F.col("role") == "assistant"
    return t.select("conv_id", "perspective", (F.col("_n0") + F.col("_n1")).alias("seq"), "turn", "speaker", "role", "segment", "start",
                    (F.col("start") + F.col("size")).alias("stop"),
                    F.when(trained, F.col("start") + F.length("head")).alias("train_start"),
                    F.when(trained, F.col("start") + F.col("size")).alias("train_stop"))
