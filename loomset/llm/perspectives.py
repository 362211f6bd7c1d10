"""Multi-party dialogues, rendered once from the view of every participant.

In a participant's view its own turns are the assistant's, the others' are
those of users who carry their names, and system turns stay. A rendering is
returned as its turns in order, each with the place where it starts in the
whole text and the span a training job may learn from, so a dialogue of any
length stays spread over many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomset.operators.running import running_before

SYSTEM_ROLES = ("system",)
UNNAMED = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LINE_BREAKS = r"[\x0A-\x0D\x{85}\x{2028}\x{2029}]+"
BLOCK_TURNS = 1024


def speaker(role: Column) -> Column:
    """The name a turn's role speaks under, on one line and without markers; NULL and blank roles are 'unknown'."""
    name = F.trim(F.regexp_replace(safe(role), LINE_BREAKS, " "))
    return F.when(name == "", F.lit(UNNAMED)).otherwise(name)


def safe(text: Column) -> Column:
    """The text without markers: every '<|' in it becomes '< |'. NULL is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system_roles: tuple[str, ...] = SYSTEM_ROLES,
) -> DataFrame:
    """One row per dialogue, participant and turn.

    ``(conv_id, participant, turn, chat_role, name, rendered, start, mask_start,
    mask_end)``: the turn as text, where it starts in the participant's
    rendering (in characters), and the part of the rendering to learn, which is
    what the assistant says and its closing mark (NULL for other turns). Joined
    in order of ``start`` the rows are the rendering.

    Participants are the speakers of a dialogue's turns but for system roles;
    a dialogue without any gives no rows. Neither texts nor names can hold a
    marker, and a name no line break, so nothing said forges a turn. Turns go by number (NULL first), then
    speaker, then text; equal rows are equal parts of the rendering, as often
    as they come. A NULL ``conv_id`` is a dialogue of its own. An empty table
    gives an empty one.

    Places are running sums in blocks of ``BLOCK_TURNS`` turn numbers, so a
    dialogue with many turns is summed up by many tasks.
    """
    key = F.coalesce(F.concat(F.lit("k"), F.col(conv_id).cast("string")), F.lit("n"))
    who = speaker(F.col(role))
    rows = turns.select(
        key.alias("_key"),
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        who.alias("_who"),
        safe(F.col(text)).alias("_text"),
        F.coalesce(F.trim(F.col(role)).isin(*system_roles), F.lit(False)).alias("_system"),
    )
    # Equal rows are numbered by their count, so that every row has a place of its own.
    same = ["_key", "conv_id", "turn", "_who", "_text", "_system"]
    counted = rows.groupBy(*same).agg(F.count("*").cast("int").alias("_times"))
    people = rows.where(~F.col("_system")).select("_key", F.col("_who").alias("participant")).distinct()
    views = counted.join(people, "_key")
    own = F.col("_who") == F.col("participant")
    chat_role = F.when(F.col("_system"), "system").when(own, "assistant").otherwise("user")
    name = F.when(~F.col("_system") & ~own, F.col("_who"))
    head = F.concat(F.lit(OPEN), chat_role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    shown = views.select(
        "*",
        chat_role.alias("chat_role"),
        name.alias("name"),
        F.concat(head, "_text", F.lit(CLOSE + "\n")).alias("rendered"),
        F.length(head).cast("bigint").alias("_head"),
        F.struct("turn", "_who", "_text").alias("_order"),
    )
    size = F.length("rendered").cast("bigint")
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / BLOCK_TURNS)
    placed = running_before(shown, ["_key", "participant"], block, "_order", _before=("sum", size * F.col("_times")))
    each = placed.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy", "_zero"))
    start = F.coalesce("_before", F.lit(0)) + F.col("_copy") * size
    learn = F.col("chat_role") == "assistant"
    return each.select(
        "conv_id",
        "participant",
        "turn",
        "chat_role",
        "name",
        "rendered",
        start.alias("start"),
        F.when(learn, start + F.col("_head")).alias("mask_start"),
        F.when(learn, start + size - 1).alias("mask_end"),
    )
