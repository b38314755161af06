"""Chat formatting by multi-party perspective rotation.

For each participant of a dialogue, the dialogue is rendered with that speaker as the assistant, the other
participants as named users and system turns as they are. The loss mask covers the content and the end mark of the
assistant's turns. Participants are the different speakers of a dialogue but the system.

A rendering of up to SEGMENT_CHARS code points is one row. A longer one comes in segments of about that size, so that
no dialogue gathers in one row whatever its length; start is the place of a segment in its rendering, and the texts of
the segments in order are the whole. The places come from sums over blocks of BLOCK turn numbers, so a dialogue's turns
never meet in one task either. Mask spans are code-point offsets in their segment, end excluded.

Turn marks inside a text or a name get a space after their first character, so that no turn can pass for another; a
line break in a name becomes a space.

Defined results: a null text is empty; a null speaker is the system; turns of equal number stand in the order of
speaker and text, null turns first; repeated rows stay; a null conversation is a conversation of its own; a dialogue
without participants has no rendering; an empty table gives an empty result; columns other than the four named are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
SEGMENT_CHARS = 1 << 20
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"


def _unmarked(c: Column) -> Column:
    return F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "< |$1|>")


def rotate_perspectives(turns: DataFrame, block: int = BLOCK, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, speaker, segment, start, n_turns, text, mask) for turns (conv_id, turn, role, text)."""
    said = turns.select(
        F.struct("conv_id").alias("conv"),  # never null, so null conversations join too
        "turn",
        F.replace(_unmarked(F.coalesce("role", F.lit(SYSTEM))), F.lit("\n"), F.lit(" ")).alias("who"),
        _unmarked(F.coalesce("text", F.lit(""))).alias("said"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long").alias("block"),
    )
    speakers = said.where(F.col("who") != SYSTEM).groupBy("conv").agg(F.collect_set("who").alias("speakers"))
    seen = said.join(speakers, "conv").withColumn("speaker", F.explode("speakers")).drop("speakers")
    own = F.col("who") == F.col("speaker")
    head = F.concat(F.lit(START), F.when(own, "assistant").when(F.col("who") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), F.col("who"))), F.lit("\n"))
    seen = seen.withColumns({"own": own, "head": head})
    size = F.length("head") + F.length("said") + len(END)
    # Where each block starts in its rendering, from the sums of the blocks before it.
    whole, keys = Window.partitionBy("conv", "speaker"), ["conv", "speaker", "block"]
    sums = seen.groupBy(*keys).agg(F.sum(size).cast("long").alias("size"))
    sums = sums.withColumn("at", F.sum("size").over(whole.orderBy("block")) - F.col("size")).drop("size")
    sums = sums.withColumn("segment", F.floor(F.col("at") / segment_chars).cast("int"))
    sums = sums.withColumn("start", F.min("at").over(whole.partitionBy("conv", "speaker", "segment")))
    in_order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("turn"), "who", "said")
    part = seen.withColumns({"n": F.row_number().over(in_order), "end": F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0))})
    part = part.join(sums, keys).withColumn("end", F.col("end") + F.col("at") - F.col("start"))
    span = F.when(F.col("own"), F.concat_ws("-", (F.col("end") - F.length("said") - len(END)).cast("string"), F.col("end").cast("string")))
    rows = F.sort_array(F.collect_list(F.struct("block", "n", F.concat("head", "said", F.lit(END)).alias("t"), span.alias("m"))))
    out = part.groupBy("conv", "speaker", "segment", "start").agg(F.count("*").alias("n_turns"), rows.alias("r"))
    return out.select("conv.conv_id", "speaker", "segment", "start", "n_turns", F.array_join(F.col("r.t"), "").alias("text"), F.array_join(F.col("r.m"), ",").alias("mask"))
