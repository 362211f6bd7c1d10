"""Multi-turn dialogues: one training example per assistant turn, and last-pair extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from loomset.operators.joins import lookup_join
from loomset.storage import materialise

# Speaker labels inside an expanded prompt.
USER_LABEL = "用户: "
ASSISTANT_LABEL = "助手: "
LABELS = (USER_LABEL, ASSISTANT_LABEL)

# Speaker names of dialogue records and the roles they stand for.
ROLE_MAP = {"human": "user", "gpt": "assistant", "system": "system"}

# Turn numbers whose lines are put together before a long dialogue's prompts are built.
_BLOCK = 64

# Turn ranges counted per long dialogue and pass when its head is looked for.
_RANGES = 4096


def map_role(speaker: Column) -> Column:
    """human → user, gpt → assistant; anything else stays as it is."""
    role = speaker
    for name, mapped in ROLE_MAP.items():
        role = F.when(speaker == name, mapped).otherwise(role)
    return role


def is_dialogue_role(role: Column) -> Column:
    """Only user and assistant turns appear in a prompt."""
    return role.isin("user", "assistant")


def labelled(role: Column, content: Column, labels: tuple[str, str] = LABELS) -> Column:
    """One line of a prompt."""
    return F.concat(F.when(role == "user", labels[0]).otherwise(labels[1]), content)


def expand_dialogues(
    df: DataFrame,
    messages: str,
    max_chars: int | None = None,
    labels: tuple[str, str] = LABELS,
) -> DataFrame:
    """One row per assistant message of an ``array<struct<role, content>>`` column.

    Adds ``turn_pos`` (place among the user and assistant messages), ``prompt``
    (all earlier ones, labelled, one per line), ``response`` and
    ``over_length``. An assistant message without earlier ones gives no row.

    A prompt repeats its dialogue, so all prompts of a long dialogue together
    grow with the square of its length. A caller that drops prompts longer than
    ``max_chars`` anyway may say so: such rows are then flagged ``over_length``
    and have a NULL prompt, whose text is never built. Without it all prompts
    are whole.
    """
    spoken = F.filter(messages, lambda m: is_dialogue_role(m["role"]))
    lines = F.transform(spoken, lambda m: labelled(m["role"], m["content"], labels))
    others = [c for c in df.columns if c != messages]
    if max_chars is None:
        exploded = (
            df.withColumn("_spoken", spoken)
            .withColumn("_lines", lines)
            .select(*others, "_lines", F.posexplode("_spoken").alias("turn_pos", "_said"))
            .where((F.col("_said.role") == "assistant") & (F.col("turn_pos") > 0))
        )
        return exploded.select(
            *others,
            "turn_pos",
            F.array_join(F.slice("_lines", F.lit(1), F.col("turn_pos")), "\n").alias("prompt"),
            F.col("_said.content").alias("response"),
            F.lit(False).alias("over_length"),
        )
    # How many leading lines fit: stops adding once the budget is used up.
    fitting = F.aggregate(
        F.col("_lines"),
        F.struct(F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("n")),
        lambda acc, line: F.when(
            acc["chars"] + F.length(line) <= max_chars,
            F.struct(
                (acc["chars"] + F.length(line) + 1).alias("chars"), (acc["n"] + 1).alias("n")
            ),
        ).otherwise(F.struct(F.lit(max_chars + 1).cast("bigint").alias("chars"), acc["n"].alias("n"))),
        lambda acc: acc["n"],
    )
    rows = (
        df.withColumn("_spoken", spoken)
        .withColumn("_lines", lines)
        .withColumn("_fitting", fitting)
        .withColumn("_head", F.slice("_lines", 1, "_fitting"))
        .drop("_lines")
    )
    exploded = rows.select(
        *others, "_fitting", "_head", F.posexplode("_spoken").alias("turn_pos", "_said")
    ).where((F.col("_said.role") == "assistant") & (F.col("turn_pos") > 0))
    over = F.col("turn_pos") > F.col("_fitting")
    prompt = F.array_join(F.slice("_head", F.lit(1), F.col("turn_pos")), "\n")
    return exploded.select(
        *others,
        "turn_pos",
        F.when(~over, prompt).alias("prompt"),
        F.col("_said.content").alias("response"),
        over.alias("over_length"),
    )


def expand_turns(
    turns: DataFrame,
    max_chars: int | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    labels: tuple[str, str] = LABELS,
) -> DataFrame:
    """``expand_dialogues`` for a flat table with one row per turn.

    Returns ``conv, turn, prompt, response, over_length``; (conv, turn) is
    unique and ``turn`` an integer. Without ``max_chars`` every prompt is whole.

    With it, longer prompts are NULL and flagged, and never built. A line costs
    its label and a line break at least, so only the first ``max_chars // cost + 2`` spoken turns of a
    dialogue can have a prompt that fits. Dialogues are counted first; those
    with more turns are cut to that head before anything is grouped by
    dialogue, however long they are. Their later assistant turns are returned
    flagged ``over_length``.
    """
    spoken = turns.where(is_dialogue_role(F.col(role))).select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.col(role).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    if max_chars is None:
        whole = _expand_whole(spoken, labels)
        return whole.withColumnRenamed("conv", conv).withColumnRenamed("turn", turn)
    head_size = max_chars // (min(map(len, labels)) + 1) + 2
    limits, n_limits = _head_limits(spoken.select("conv", "turn"), head_size)
    heads = spoken
    if n_limits:
        limited = lookup_join(spoken, limits, "conv", "left", n_limits)
        heads = limited.where(F.col("hi").isNull() | (F.col("turn") <= F.col("hi"))).drop("hi")

    order = Window.partitionBy("conv").orderBy("turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        heads.withColumn("place", F.row_number().over(order))
        .withColumn("line", labelled(F.col("role"), F.col("text"), labels))
        .withColumn("used", F.sum(F.length("line") + 1).over(before) - 1)
    )
    # Lines behind the budget never enter a frame, so a frame holds at most
    # the budget plus one line.
    framed = F.collect_list(F.when(F.coalesce("used", F.lit(0)) <= max_chars, F.col("line")))
    examples = (
        heads.withColumn("lines", framed.over(before))
        .where((F.col("role") == "assistant") & (F.col("place") > 1))
        .select(
            "conv",
            "turn",
            F.when(F.col("used") <= max_chars, F.array_join("lines", "\n")).alias("prompt"),
            F.col("text").alias("response"),
            (F.col("used") > max_chars).alias("over_length"),
        )
    )
    if n_limits:
        later = (
            lookup_join(spoken, limits, "conv", "inner", n_limits)
            .where((F.col("role") == "assistant") & (F.col("turn") > F.col("hi")))
            .select(
                "conv",
                "turn",
                F.lit(None).cast("string").alias("prompt"),
                F.col("text").alias("response"),
                F.lit(True).alias("over_length"),
            )
        )
        examples = examples.unionByName(later)
    return examples.withColumnRenamed("conv", conv).withColumnRenamed("turn", turn)


def _expand_whole(spoken: DataFrame, labels: tuple[str, str]) -> DataFrame:
    """Whole prompts of ``conv, turn, role, text``.

    Lines are put together per block of ``_BLOCK`` turn numbers, and per block
    the text of all blocks before it, so the prompts of a long dialogue are
    built by as many tasks as it has blocks; a task holds a prompt at a time.
    """
    lines = spoken.withColumn("block", F.floor(F.col("turn") / _BLOCK)).withColumn(
        "line", labelled(F.col("role"), F.col("text"), labels)
    )
    in_order = F.sort_array(F.collect_list(F.struct("turn", "line")))
    blocks = lines.groupBy("conv", "block").agg(
        F.array_join(F.transform(in_order, lambda x: x["line"]), "\n").alias("body"),
        F.max(F.col("role") == "assistant").alias("answers"),
    )
    blocks = materialise(blocks, "blocks")
    later = blocks.where("answers").select("conv", F.col("block").alias("of"))
    earlier = F.sort_array(F.collect_list(F.struct("block", "body")))
    heads = (
        later.join(blocks.select("conv", "block", "body"), "conv")
        .where("block < of")
        .groupBy("conv", "of")
        .agg(F.array_join(F.transform(earlier, lambda x: x["body"]), "\n").alias("head"))
        .withColumnRenamed("of", "block")
    )
    before = (
        Window.partitionBy("conv", "block")
        .orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    answers = lines.withColumn("near", F.collect_list("line").over(before)).where("role = 'assistant'")
    near = F.when(F.size("near") > 0, F.array_join("near", "\n"))
    return (
        answers.join(heads, ["conv", "block"], "left")
        .where(F.col("head").isNotNull() | (F.size("near") > 0))
        .select(
            "conv",
            "turn",
            F.concat_ws("\n", "head", near).alias("prompt"),
            F.col("text").alias("response"),
            F.lit(False).alias("over_length"),
        )
    )


def _head_limits(spoken: DataFrame, head_size: int) -> tuple[DataFrame, int]:
    """Per dialogue longer than ``head_size`` turns: a turn number ``hi`` closing its head.

    At least ``head_size`` turns, and at most five times as many, are numbered
    up to ``hi``. Turns are counted in equal ranges of turn numbers, and the
    range in which the head ends is looked at again until it is small; counts
    are combined map-side and a dialogue has at most ``_RANGES`` of them per pass.
    """
    limits = materialise(
        spoken.groupBy("conv")
        .agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"))
        .where(F.col("n") > head_size)
        .withColumn("need", F.lit(head_size).cast("bigint")),
        "limits",
    )
    n_limits = limits.count()
    while limits.where((F.col("n") > 4 * head_size) & (F.col("hi") > F.col("lo"))).limit(1).count():
        width = F.floor((F.col("hi") - F.col("lo")) / _RANGES) + 1
        part = F.floor((F.col("turn") - F.col("lo")) / width)
        before = (
            Window.partitionBy("conv")
            .orderBy("part")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        start = F.col("lo") + F.col("part") * width
        limits = materialise(
            lookup_join(spoken, limits.drop("n"), "conv", "inner", n_limits)
            .where(F.col("turn").between(F.col("lo"), F.col("hi")))
            .groupBy("conv", "lo", "hi", "need", part.alias("part"))
            .agg(F.count("*").alias("n"))
            .withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .where(
                (F.col("earlier") < F.col("need"))
                & (F.col("need") <= F.col("earlier") + F.col("n"))
            )
            .select(
                "conv",
                "n",
                start.alias("lo"),
                F.least("hi", start + width - 1).alias("hi"),
                (F.col("need") - F.col("earlier")).alias("need"),
            ),
            "limits",
        )
    return limits.select("conv", "hi"), n_limits


def last_pair(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Per dialogue: the last non-empty user text and the last non-empty assistant text.

    The two are found independently; a side that never spoke is ''. One
    aggregation with partial results per task, so long dialogues do not matter.
    """

    def last(speaker: str) -> Column:
        wanted = (F.col(role) == speaker) & (F.col(text) != "")
        found = F.max_by(text, F.when(wanted, F.col(turn)))
        return F.coalesce(found, F.lit(""))

    return turns.groupBy(conv).agg(
        last("user").alias("prompt"), last("assistant").alias("response")
    )


def final_pair(messages: Column, strict: bool = False) -> tuple[Column, Column]:
    """(prompt, response) of a message array: last non-empty user and assistant content.

    ``strict`` takes the user message from in front of the chosen assistant message.
    """
    numbered = F.transform(
        messages, lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), i.alias("i"))
    )

    def last(array: Column, speaker: str) -> Column:
        said = F.filter(array, lambda m: (m["role"] == speaker) & (m["content"] != ""))
        return F.try_element_at(said, F.lit(-1))

    answer = last(numbered, "assistant")
    asked = numbered
    if strict:
        asked = F.filter(numbered, lambda m: m["i"] < answer["i"])
    return (
        F.coalesce(last(asked, "user")["content"], F.lit("")),
        F.coalesce(answer["content"], F.lit("")),
    )
