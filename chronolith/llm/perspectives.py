"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered once more, with that
participant's turns as the assistant's, everyone else's as those of users with names, and a loss mask
over what the assistant says. The result has a row for each turn and perspective: its rendered
segment, where it lies in the rendered dialogue, and the masked span. A dialogue is the segments of
its conversation and perspective in order of `start`; render() puts it together.

A conversation is never gathered: its turns are cut into blocks of BLOCK consecutive numbers, and a block
that holds more than HOT turns, since numbers are equal or null, into pieces by number, speaker and
hash of the text. A pass without texts sums lengths by block and finds the participants; texts then move
once, to their block.

Defined results: role `system` is no participant, its turns stay the system's; a null role is the
participant `unknown`; a null text is empty; null turns come first; equal turn numbers go by role, then
MD5 of the text; a null conv_id is a conversation of its own; repeated rows each count as turns; a conversation
of system turns alone has no perspective and gives no rows, nor does an empty table. In names, what
could break the template becomes `_`; in texts, the markers' opening is split by a zero-width space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, table, written

# Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT, SYSTEM, UNKNOWN = "assistant", "system", "unknown"

#: Turn numbers in a block, turns from which a block is cut further, and turns in such a piece or so.
BLOCK, HOT, PIECE = 256, 1024, 4096


def _name(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit(UNKNOWN)), r"[<>|\r\n]", "_")


def _user(name: Column) -> Column:
    return F.concat(F.lit("user name="), name)


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, speaker and block, a struct in the order of the dialogue; __body is the text as
    rendered, __single whether one speaker alone has the block."""
    name = _name(F.col("role"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\u200b|"))
    number = F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / BLOCK).cast("long")
    rows = conversations.select("conv_id", "turn", name.alias("speaker"), number.alias("__number"), body.alias("__body"))
    hot = rows.groupBy("conv_id", "__number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    hot = written(hot.select(F.col("conv_id").alias("__c"), F.col("__number").alias("__b"), F.ceil(F.col("n") / PIECE).alias("__pieces")), "dialogue-hot")
    if hot.limit(BROADCAST_KEYS // 10 + 1).count() <= BROADCAST_KEYS // 10:
        hot = F.broadcast(hot)
    rows = rows.join(hot, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__number") == F.col("__b")), "left")
    digest = F.md5(F.col("__body").cast("binary"))
    piece = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.col("__pieces") / F.lit(1 << 32)).cast("int")
    single = F.col("__pieces").isNotNull()
    block = F.struct(F.col("__number").alias("number"), F.when(single, F.col("turn")).alias("turn"), F.when(single, F.col("speaker")).alias("speaker"), F.when(single, piece).alias("piece"))
    return rows.select("conv_id", "turn", "speaker", block.alias("block"), digest.alias("__digest"), "__body", single.alias("__single"))


def _length(speaker: Column, body_length: Column) -> Column:
    """Of a segment whose speaker is not the assistant of the perspective."""
    header = F.when(speaker == SYSTEM, F.lit(len(SYSTEM))).otherwise(F.length(_user(speaker)))
    return (len(OPEN) + header + 1 + body_length + len(CLOSE)).cast("long")


def _less(name: Column) -> Column:
    """By how much a segment grows when its speaker becomes the assistant."""
    return (F.lit(len(ASSISTANT)) - F.length(_user(name))).cast("long")


def block_starts(turns: DataFrame) -> DataFrame:
    """conv_id, block, and for each perspective where the block starts in its dialogue."""
    sums = turns.groupBy("conv_id", "block", "speaker").agg(F.sum(_length(F.col("speaker"), F.length("__body"))).alias("length"), F.count(F.lit(1)).alias("n"))
    sums = written(sums, "dialogue-lengths")
    blocks = sums.groupBy("conv_id", "block").agg(F.sum("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("speaker", "n"))).alias("by"))
    who = sums.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("__c"), F.col("speaker").alias("perspective")).distinct()
    rows = blocks.join(who, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    mine = F.col("length") + F.coalesce(F.try_element_at("by", F.col("perspective")), F.lit(0)) * _less(F.col("perspective"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), "perspective", F.coalesce(F.sum(mine).over(before), F.lit(0)).cast("long").alias("block_start"))


def rotated(conversations: DataFrame) -> DataFrame:
    """A row for each turn and perspective of conversations (conv_id, turn, role, text)."""
    turns = _turns(conversations)
    starts = block_starts(turns)
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "__digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("__length", _length(F.col("speaker"), F.length("__body")))
    rows = rows.withColumns({"__before": F.coalesce(F.sum("__length").over(order), F.lit(0)), "__spoke": F.collect_list(F.when(~F.col("__single"), F.col("speaker"))).over(order), "__count": F.count(F.lit(1)).over(order)})
    rows = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("block").eqNullSafe(F.col("__b")))
    own = F.col("speaker") == F.col("perspective")
    header = F.when(own, F.lit(ASSISTANT)).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(_user(F.col("speaker")))
    listed = F.size(F.filter("__spoke", lambda s: s == F.col("perspective")))
    earlier = F.when(F.col("__single"), F.when(own, F.col("__count")).otherwise(0)).otherwise(listed)
    start = F.col("block_start") + F.col("__before") + earlier * _less(F.col("perspective"))
    rows = rows.select("conv_id", "perspective", "turn", "speaker", own.alias("is_assistant"), F.concat(F.lit(OPEN), header, F.lit("\n"), "__body", F.lit(CLOSE)).alias("segment"), F.length(header).alias("__h"), start.cast("long").alias("start"))
    end = F.col("start") + F.length("segment")
    said = F.col("start") + len(OPEN) + F.col("__h") + 1
    # what the assistant says and the marker that ends it, without the line end
    return rows.select(
        "conv_id", "perspective", "turn", "speaker", "segment", "start", end.alias("end"), F.when(F.col("is_assistant"), said).alias("mask_start"), F.when(F.col("is_assistant"), end - 1).alias("mask_end")
    )


def render(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, the dialogue's text and its masked spans. Gathers each dialogue in one
    row: for conversations that fit into one, as those made for training do."""
    parts = F.sort_array(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    rows = segments.groupBy("conv_id", "perspective").agg(parts.alias("p"))
    masks = F.transform(F.filter("p", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return rows.select("conv_id", "perspective", F.array_join("p.segment", "").alias("dialogue"), masks.alias("masks"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(table(spark, sf_dir, "conversations"))
