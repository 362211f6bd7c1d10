"""Record layout detection and normalisation to prompt/response pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomset.functions.once import with_once
from loomset.operators.dialogues import final_pair, is_dialogue_role, labelled, map_role
from loomset.operators.joins import lookup_join

# Layouts and their display names.
FORMAT_NAMES = {
    "plain_text": "纯文本",
    "alpaca": "Alpaca (instruction/input/output)",
    "sharegpt": "ShareGPT (conversations)",
    "chatml": "ChatML (messages)",
    "openai_ft": "OpenAI Fine-tuning (messages)",
    "cot": "Chain-of-Thought (Question/Complex_CoT/Response)",
    "general_json": "通用 JSON",
}

# Field names tried in this order for records of no known layout.
PROMPT_KEYS = ("instruction", "input", "question", "prompt", "q", "query")
RESPONSE_KEYS = ("output", "response", "answer", "a", "completion", "content")

# Fixed value: what an empty data set counts as.
NO_RECORD_FORMAT = "plain_text"

MODES = ("first", "per_file", "per_record")

_TURNS = {
    "sharegpt": ("conversations", "from", "value"),
    "chatml": ("messages", "role", "content"),
}


def has(raw: Column, path: str) -> Column:
    """Whether the record has the key, whatever its value (a JSON null counts)."""
    return F.variant_get(raw, f"$.{path}", "variant").isNotNull()


def field(raw: Column, key: str) -> Column:
    """The key's value as text; missing or null gives ''."""
    return F.coalesce(F.try_variant_get(raw, f"$.{key}", "string"), F.lit(""))


def is_truthy(raw: Column, key: str) -> Column:
    """Whether the key's value counts as given: not missing, null, '', 0, false, [] or {}."""
    text = field(raw, key)
    kind = F.schema_of_variant(F.variant_get(raw, f"$.{key}", "variant"))
    zero = text.isin("0", "0.0", "false", "[]", "{}")
    return F.when(zero, kind == "STRING").otherwise(text != "")


def is_object(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))


def format_expr(raw: Column) -> Column:
    """Layout of one record: the first rule that fits."""
    turn_of = {f: f"{array}[0].{speaker}" for f, (array, speaker, _) in _TURNS.items()}
    return (
        F.when(has(raw, "instruction") & has(raw, "output"), "alpaca")
        .when(has(raw, turn_of["sharegpt"]), "sharegpt")
        .when(has(raw, turn_of["chatml"]), "chatml")
        .when(has(raw, "Question") & has(raw, "Complex_CoT") & has(raw, "Response"), "cot")
        .when(has(raw, "text"), "plain_text")
        .otherwise("general_json")
    )


def format_name(fmt: Column) -> Column:
    """Display name of a layout; an unknown layout is its own name."""
    name = fmt
    for key, shown in FORMAT_NAMES.items():
        name = F.when(fmt == key, shown).otherwise(name)
    return name


def first_format(records: DataFrame, *order: str) -> str | None:
    """Layout of the first record by ``order``, None if there is no valid record.

    Malformed records (``raw`` NULL) have no layout and do not count.

    The order columns are narrow; records themselves are not sorted or moved.
    """
    valid = records.where(F.col("raw").isNotNull())
    layouts = valid.select(*order, format_expr(F.col("raw")).alias("fmt"))
    return layouts.agg(F.min_by("fmt", F.struct(*order)).alias("fmt")).first()["fmt"]


def detect_format(
    records: DataFrame,
    mode: str = "first",
    order: tuple[str, ...] = ("path", "block_start", "rid"),
    n_files: int | None = None,
) -> DataFrame:
    """Add ``fmt``: of the data set's first record, of each file's first, or of each record.

    First means first valid: malformed records take the layout of the others. A
    file without any valid record has that of an empty data set.

    ``order`` starts with the file. ``n_files``, if known, bounds the number of
    files and so the table of their layouts (see ``lookup_join``).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode == "per_record":
        return records.withColumn("fmt", format_expr(F.col("raw")))
    if mode == "first":
        fmt = first_format(records, *order) or NO_RECORD_FORMAT
        return records.withColumn("fmt", F.lit(fmt))
    # The layout is taken before grouping: records themselves are not sorted.
    valid = records.where(F.col("raw").isNotNull())
    layouts = valid.select(*order, format_expr(F.col("raw")).alias("fmt"))
    per_file = layouts.groupBy(order[0]).agg(F.min_by("fmt", F.struct(*order[1:])).alias("fmt"))
    found = lookup_join(records, per_file, order[0], "left", n_files)
    return found.withColumn("fmt", F.coalesce("fmt", F.lit(NO_RECORD_FORMAT)))


def messages(raw: Column, fmt: str) -> Column:
    """The turns of a dialogue record as ``array<struct<role, content>>``, NULL if not an array."""
    array, speaker, said = _TURNS[fmt]
    turns = F.try_variant_get(
        raw, f"$.{array}", f"array<struct<`{speaker}` string, `{said}` string>>"
    )
    role = map_role if fmt == "sharegpt" else (lambda c: c)
    return F.transform(
        turns,
        lambda t: F.struct(role(t[speaker]).alias("role"), t[said].alias("content")),
    )


def broken_turns(turns: Column) -> Column:
    """Whether some turn lacks its speaker, or a spoken turn its text."""
    return F.exists(
        turns,
        lambda t: t["role"].isNull() | (is_dialogue_role(t["role"]) & t["content"].isNull()),
    )


def _pair(
    prompt: Column, response: Column, system: Column, cot: Column | None = None,
    error: Column | None = None,
) -> Column:
    return F.struct(
        prompt.alias("prompt"),
        response.alias("response"),
        system.alias("system"),
        (F.lit("") if cot is None else cot).alias("cot"),
        (F.lit(False) if error is None else error).alias("error"),
    )


def _sharegpt_pair(raw: Column, system: Column) -> Column:
    given = messages(raw, "sharegpt")
    none = F.array().cast("array<struct<role:string,content:string>>")
    turns = F.coalesce(given, none)

    def last(speaker: str) -> Column:
        said = F.filter(turns, lambda t: t["role"] == speaker)
        return F.coalesce(F.try_element_at(said, F.lit(-1))["content"], F.lit(""))

    final = F.try_element_at(turns, F.lit(-1))
    answered = final["role"] == "assistant"
    context = F.filter(
        turns,
        lambda t, i: is_dialogue_role(t["role"]) & ~(answered & (i == F.size(turns) - 1)),
    )
    lines = F.transform(context, lambda t: labelled(t["role"], t["content"]))
    short = F.size(turns) <= 2
    return _pair(
        F.when(short, last("user")).otherwise(F.array_join(lines, "\n")),
        F.when(short, last("assistant")).otherwise(
            F.when(answered, final["content"]).otherwise("")
        ),
        system,
        error=F.coalesce(broken_turns(given), has(raw, "conversations")),
    )


def _first_present(raw: Column, keys: tuple[str, ...]) -> Column:
    value = F.lit("")
    for key in reversed(keys):
        value = F.when(has(raw, key), field(raw, key)).otherwise(value)
    return value


def pair_expr(raw: Column, fmt: str, system: Column, strict_pair: bool = False) -> Column:
    """Struct ``prompt, response, system, cot, error`` of a record of the given layout."""
    if fmt == "alpaca":
        instruction, extra = field(raw, "instruction"), field(raw, "input")
        both = F.concat_ws("\n", instruction, extra)
        prompt = F.when(is_truthy(raw, "input"), both).otherwise(instruction)
        return _pair(prompt, field(raw, "output"), system)
    if fmt == "sharegpt":
        return _sharegpt_pair(raw, system)
    if fmt == "chatml":
        turns = messages(raw, "chatml")
        prompt, response = final_pair(turns, strict_pair)
        return _pair(
            prompt, response, system, error=F.coalesce(broken_turns(turns), has(raw, "messages"))
        )
    if fmt == "cot":
        return _pair(
            field(raw, "Question"), field(raw, "Response"), system, field(raw, "Complex_CoT")
        )
    if fmt == "plain_text":
        return _pair(F.lit(""), field(raw, "text"), system)
    return _pair(_first_present(raw, PROMPT_KEYS), _first_present(raw, RESPONSE_KEYS), system)


def to_pair(
    df: DataFrame, fmt: str | None = None, system: str = "", strict_pair: bool = False
) -> DataFrame:
    """Replace ``raw`` by ``prompt, response, system, cot, error``.

    One layout for all records if ``fmt`` is given, else the one in column
    ``fmt``. A record that is not an object, or has broken turns, gets
    ``error``; a record marked ``_prebuilt`` is taken as it is.
    """
    raw, sys_text = F.col("raw"), F.lit(system)
    if fmt is not None:
        pair = pair_expr(raw, fmt, sys_text, strict_pair)
    else:
        pair = pair_expr(raw, "general_json", sys_text)
        for name in ("alpaca", "sharegpt", "chatml", "cot", "plain_text"):
            pair = F.when(
                F.col("fmt") == name, pair_expr(raw, name, sys_text, strict_pair)
            ).otherwise(pair)
    prebuilt = _pair(
        field(raw, "prompt"),
        field(raw, "response"),
        F.when(has(raw, "system"), field(raw, "system")).otherwise(sys_text),
        field(raw, "cot"),
    )
    ready = F.coalesce(F.try_variant_get(raw, "$._prebuilt", "boolean"), F.lit(False))
    broken = _pair(F.lit(""), F.lit(""), sys_text, error=F.lit(True))
    pair = F.when(~is_object(raw), broken).when(ready, prebuilt).otherwise(pair)
    others = [c for c in df.columns if c != "raw"]
    return with_once(df, "_pair", pair).select(*others, "_pair.*")
