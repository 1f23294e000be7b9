"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once,
with that speaker as the assistant, every other speaker as a named user, and
the loss mask on the assistant's turns alone. Turns of the system are context
in every rendering and nobody's perspective.

A rendering comes as one row per turn, with the turn's place in it and the
character span it covers, so that no task ever holds a whole conversation; a
rendering is the rows' text in order of seq. Spans come from running totals
within blocks of turns and over the blocks' sums, so that a conversation with
a third of all rows is dealt over many tasks.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive turn numbers in a block.
BLOCK_TURNS = 256

SYSTEM = "system"


def _head(role: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))
    return F.when(role == "assistant", F.lit("<|assistant|>\n")).when(role == SYSTEM, F.lit("<|system|>\n")).otherwise(named)


END = "<|end|>\n"


#: Stands for a conversation without a number.
NO_CONV = -(1 << 63)


def rotate(turns: DataFrame) -> DataFrame:
    """Rows conv_id, participant, seq, turn, speaker, role, rendered, loss (0 or 1),
    start, length, loss_start and loss_length, in characters of the rendering.

    turns: conv_id, turn, role and text. role names the speaker. A null or empty
    role is the speaker "unknown"; null text counts as empty; a null turn comes
    before all others; turns without a conv_id are one conversation. Turns with one
    number are ordered by speaker and text, and repeated rows are rendered as often
    as they come. A conversation in which only the system speaks has no participant
    and no rendering. Other columns don't matter.

    A block's texts are shuffled once; what differs between perspectives comes from
    small tables of the blocks' sums.
    """
    speaker = F.when(F.coalesce(F.trim("role"), F.lit("")) == "", F.lit("unknown")).otherwise(F.trim("role"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62)))
    rows = turns.select(F.coalesce("conv_id", F.lit(NO_CONV)).alias("conv"), block.alias("block"), "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))

    # a turn's length, and how much shorter it is where its speaker is the assistant
    system = F.col("speaker") == SYSTEM
    user_head = F.length(F.when(system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n"))))
    length = (user_head + F.length("text") + len(END)).cast("bigint")
    less = (user_head - len("<|assistant|>\n")).cast("bigint")

    per = rows.groupBy("conv", "block", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("l"), F.sum(less).alias("d"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = per.groupBy("conv", "block").agg(F.sum("n").alias("n"), F.sum("l").alias("l"))
    sums = sums.select("conv", "block", F.coalesce(F.sum("n").over(earlier), zero).alias("i0"), F.coalesce(F.sum("l").over(earlier), zero).alias("l0"))
    participants = per.where(~system).select("conv", F.col("speaker").alias("participant")).distinct()
    own = per.select("conv", "block", F.col("speaker").alias("participant"), "d")
    placed = sums.join(participants, "conv").join(own, ["conv", "block", "participant"], "left")
    mine_before = Window.partitionBy("conv", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select("conv", "block", "participant", "i0", (F.col("l0") - F.coalesce(F.sum("d").over(mine_before), zero)).alias("at0"))

    seen = rows.repartition("conv", "block").join(offsets, ["conv", "block"])
    mine = F.col("speaker") == F.col("participant")
    inside = Window.partitionBy("conv", "block", "participant").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("length", length - F.when(mine, less).otherwise(zero))
    role = F.when(mine, F.lit("assistant")).when(system, F.lit(SYSTEM)).otherwise(F.lit("user"))
    out = seen.select(
        F.when(F.col("conv") != NO_CONV, F.col("conv")).alias("conv_id"),
        "participant",
        (F.col("i0") + F.row_number().over(inside) - 1).alias("seq"),
        "turn",
        "speaker",
        role.alias("role"),
        "text",
        mine.cast("int").alias("loss"),
        (F.col("at0") + F.coalesce(F.sum("length").over(before), zero)).alias("start"),
        "length",
    )
    head = _head(F.col("role"), F.col("speaker"))
    return out.select(
        "conv_id",
        "participant",
        "seq",
        "turn",
        "speaker",
        "role",
        F.concat(head, "text", F.lit(END)).alias("rendered"),
        "loss",
        "start",
        "length",
        F.when(F.col("loss") == 1, F.col("start") + F.length(head)).alias("loss_start"),
        F.when(F.col("loss") == 1, F.col("length") - F.length(head)).alias("loss_length"),
    )
