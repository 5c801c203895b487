"""Chat formatting by perspective rotation.

A dialogue of several participants is rendered once for each of them: that speaker's turns are the
assistant's, the others' are named users, system turns stay system turns. The result is one row per
perspective and turn: the rendered turn, where it stands in that rendering, and which characters of it are
trained on (the assistant's words and end mark). Joining the rendered turns in order gives the text.

Participants are the distinct roles of a conversation but ``system``; a conversation without any gives no
rows. A null role is ``unknown``, a null text empty, rows with a null conversation id are one
conversation. Turns are ordered by number (null first), equal ones by speaker and text; repeated rows are
rendered as often as they occur. Offsets are running sums over sorted chunks, so that a very long
conversation is cut like any other. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweave.operators.ordering import ordered_chunks

SYSTEM = "system"
END = "<|end|>\n"


def running_start(rows: DataFrame, keys: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """Sum of ``size`` over the rows before within the keys, without a window over a whole key."""
    chunks = ordered_chunks(rows, *keys, *order)
    inside = Window.partitionBy("_chunk", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*keys)
    last = chunks.groupBy("_chunk").agg(F.max_by(key, "_pos").alias("_key"))  # one row per chunk
    sums = chunks.groupBy("_chunk", key.alias("_key")).agg(F.sum(size).alias("_sum"))
    tails = sums.join(last, ["_chunk", "_key"])
    # only a chunk's last key goes on into the next ones
    tails = tails.select(F.col("_chunk").alias("_from"), "_key", "_sum")
    starts = chunks.groupBy("_chunk").agg(F.min_by(key, "_pos").alias("_key"))
    carried = starts.join(tails, (starts["_key"].eqNullSafe(tails["_key"])) & (F.col("_from") < F.col("_chunk")))
    carried = carried.groupBy("_chunk", starts["_key"]).agg(F.sum("_sum").alias("_carry"))
    joined = chunks.withColumn("_key", key).join(F.broadcast(carried), ["_chunk", "_key"], "left")
    before = F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return joined.select(*rows.columns, before.cast("long").alias(name))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, perspective, turn, speaker, part, rendered, start, stop, mask_start, mask_stop (all in code points)."""
    speaker = F.coalesce(F.col(role_col), F.lit("unknown"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), speaker.alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    views = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(views, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    part = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("part", part)
    name = F.when(F.col("part") == "user", F.concat(F.lit(" name="), "speaker")).otherwise("")
    head = F.concat(F.lit("<|"), "part", name, F.lit("|>\n"))
    seen = seen.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, "text", F.lit(END)))
    seen = seen.withColumn("size", F.length("rendered").cast("long"))
    placed = running_start(seen, ["conv_id", "perspective"], ["turn", "speaker", "text"], "size", "start")
    stop = F.col("start") + F.col("size")
    mine = F.col("part") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "part", "rendered", "start", stop.alias("stop"),
        F.when(mine, F.col("start") + F.col("head")).alias("mask_start"), F.when(mine, stop).alias("mask_stop"),
    )


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') speaker, coalesce(text, '') txt FROM conversations),
v AS (SELECT DISTINCT conv_id conv, speaker perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END part
      FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv),
h AS (SELECT *, '<|' || part || CASE WHEN part = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) head FROM s),
r AS (SELECT *, head || txt || '<|end|>' || chr(10) rendered FROM h),
p AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective
      ORDER BY turn NULLS FIRST, speaker, txt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) start_at FROM r)
SELECT conv_id, perspective, turn, speaker, part, rendered, start_at "start", start_at + length(rendered) "stop",
       CASE WHEN part = 'assistant' THEN start_at + length(head) END mask_start,
       CASE WHEN part = 'assistant' THEN start_at + length(rendered) END mask_stop FROM p
"""
