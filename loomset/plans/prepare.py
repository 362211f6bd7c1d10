"""Records or turns to deduplicated, split training examples."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from loomset.functions.once import with_once
from loomset.functions.render import CHAT_TASKS, chat_messages, render, render_chat
from loomset.functions.text import py_strip
from loomset.operators.dialogues import LABELS, expand_dialogues, expand_turns
from loomset.operators.formats import (
    FORMAT_NAMES,
    MODES,
    NO_RECORD_FORMAT,
    broken_turns,
    detect_format,
    first_format,
    is_object,
    messages,
    to_pair,
)
from loomset.operators.ordering import order_key, source_key, split_exact
from loomset.operators.quality import dedup_prefix, reject_reason
from loomset.sources.records import read_records, scan_files

# Fixed value: the default system prompt.
SYSTEM_PROMPT = "你是一个有用的AI助手，请根据用户的问题给出准确、有帮助的回答。"


@dataclass(frozen=True)
class PrepareConfig:
    """Settings of a preparation run, with their usual defaults."""

    task_type: str = "instruction"
    system_prompt: str = SYSTEM_PROMPT
    val_split: float = 0.05
    shuffle: bool = True
    seed: int = 42
    quality_check: bool = True
    min_length: int = 10
    max_length: int = 8192
    dedup: bool = True
    dedup_key_len: int = 200
    dedup_on: str = "text"  # or 'pair': prompt and response without the template
    format_mode: str = "first"  # or 'per_file', 'per_record'
    labels: tuple[str, str] = LABELS
    strict_pair: bool = False
    chat_template: bool = False  # render a message array instead of the fixed template
    add_generation_prompt: bool = True

    @classmethod
    def from_mapping(cls, config: Mapping) -> PrepareConfig:
        """Settings from nested sections ``data`` and ``direction``, as in a YAML run file.

        A file that does not mention ``dedup`` gets none.
        """
        known = {f.name for f in fields(cls)}
        merged = {"dedup": False, **config.get("direction", {}), **config.get("data", {})}
        return cls(**{k: v for k, v in merged.items() if k in known})

    def __post_init__(self) -> None:
        if self.format_mode not in MODES:
            raise ValueError(f"format_mode must be one of {MODES}")
        if self.dedup_on not in ("text", "pair"):
            raise ValueError("dedup_on must be 'text' or 'pair'")


def prompt_limit(cfg: PrepareConfig) -> int | None:
    """The longest prompt an example may have, where that follows from the rules alone.

    Only if texts are checked, and hold their prompt between other parts, is an
    example of a longer prompt rejected whatever else is in it.
    """
    inside = cfg.task_type in ("instruction", "classification") or (
        cfg.chat_template and cfg.task_type in CHAT_TASKS
    )
    return cfg.max_length if cfg.quality_check and inside else None


def example_text(cfg: PrepareConfig) -> Column:
    """Stripped training text of columns ``prompt, response, system, cot``."""
    parts = [F.col(c) for c in ("prompt", "response", "system", "cot")]
    if cfg.chat_template and cfg.task_type in CHAT_TASKS:
        text = render_chat(chat_messages(cfg.task_type, *parts), cfg.add_generation_prompt)
    else:
        text = render(cfg.task_type, *parts)
    return py_strip(text)


def judged(examples: DataFrame, cfg: PrepareConfig) -> DataFrame:
    """Add ``text`` and ``reject_reason`` to examples.

    Examples have ``prompt, response, system, cot`` and the flags ``error`` and
    ``over_length``; an over-long example has no prompt and gets no text.
    """
    usable = ~F.coalesce("over_length", F.lit(False)) & ~F.coalesce("error", F.lit(False))
    return with_once(examples, "text", F.when(usable, example_text(cfg))).withColumn(
        "reject_reason",
        reject_reason(
            F.col("text"),
            cfg.min_length,
            cfg.max_length,
            error=F.col("error"),
            over_length=F.col("over_length"),
            check=cfg.quality_check,
        ),
    )


def clean(examples: DataFrame, cfg: PrepareConfig) -> DataFrame:
    """Examples that pass the quality rules, first of each prefix, with their text.

    ``order_key`` gives the order. The text repeats prompt and response, so it
    is dropped before the dedup shuffle and rendered again behind it: only the
    key travels.
    """
    kept = judged(examples, cfg).where(F.col("reject_reason").isNull())
    if cfg.dedup:
        source = F.col("text")
        if cfg.dedup_on == "pair":
            source = F.concat_ws("\n", "prompt", "response")
        keyed = kept.withColumn("_key", F.substring(source, 1, cfg.dedup_key_len)).drop("text")
        kept = dedup_prefix(keyed, "order_key", key=F.col("_key")).drop("_key")
        kept = kept.withColumn("text", example_text(cfg))
    return kept.drop("reject_reason", "error", "over_length")


def finish(examples: DataFrame, cfg: PrepareConfig) -> DataFrame:
    """Quality rules, dedup and the exact split of examples that carry ``order_key``."""
    return split_exact(clean(examples, cfg), "order_key", cfg.val_split)


def _with_order(df: DataFrame, cfg: PrepareConfig, identity: Column, place: Column) -> DataFrame:
    return df.withColumn("order_key", order_key(identity, cfg.seed) if cfg.shuffle else place)


def place_key(df: DataFrame, column: str) -> Column:
    """A sort key of hex digits in order of an id column, numbers by value and texts by their bytes."""
    if isinstance(df.schema[column].dataType, StringType):
        return F.concat(F.hex(F.encode(column, "UTF-8")), F.lit("/"))
    return F.lpad(F.hex(column), 16, "0")


def turn_examples(turns: DataFrame, cfg: PrepareConfig) -> DataFrame:
    """Examples of a flat turn table ``conv_id, turn, role, text``."""
    expanded = expand_turns(turns, prompt_limit(cfg), labels=cfg.labels).select(
        "*",
        F.lit(cfg.system_prompt).alias("system"),
        F.lit("").alias("cot"),
        F.lit(False).alias("error"),
    )
    identity = F.concat_ws("-", "conv_id", "turn")
    place = F.concat(place_key(expanded, "conv_id"), place_key(expanded, "turn"))
    return _with_order(expanded, cfg, identity, place)


def document_examples(docs: DataFrame, cfg: PrepareConfig) -> DataFrame:
    """Examples of a plain-text table ``doc_id, text``."""
    plain = docs.select(
        "doc_id",
        F.lit("").alias("prompt"),
        F.coalesce("text", F.lit("")).alias("response"),
        F.lit(cfg.system_prompt).alias("system"),
        F.lit("").alias("cot"),
        F.lit(False).alias("error"),
        F.lit(False).alias("over_length"),
    )
    return _with_order(plain, cfg, F.col("doc_id"), place_key(plain, "doc_id"))


def record_examples(
    records: DataFrame, cfg: PrepareConfig, fmt: str | None = None
) -> tuple[DataFrame, str | None]:
    """Examples of scanned records, and the layout if it is one for all.

    Dialogue records give one example per assistant turn; if no record of that
    layout gives any, they are taken as single pairs.
    """
    if fmt is None and cfg.format_mode == "first":
        fmt = first_format(records, "path", "block_start", "rid") or NO_RECORD_FORMAT
    if fmt is not None:
        typed = records.withColumn("fmt", F.lit(fmt))
    else:
        typed = detect_format(records, cfg.format_mode, n_files=len(records.inputFiles()))
    place = source_key(F.col("path"), F.col("block_start"), F.col("rid"))
    identity = F.coalesce("json", F.lit(""))
    placed = _with_order(typed, cfg, identity, place).select("path", "fmt", "order_key", "raw")

    expanded = None
    if fmt in (None, "sharegpt"):
        dialogues = expanded_pairs(placed.where(F.col("fmt") == "sharegpt"), cfg)
        expanded = dialogues.withColumn(
            "order_key", _turn_key(cfg, F.col("order_key"), F.col("turn_pos"))
        ).drop("turn_pos")
        if expanded.where(~F.col("error")).limit(1).isEmpty():
            expanded = None
    if expanded is not None and fmt == "sharegpt":
        return expanded, fmt
    singles = placed if expanded is None else placed.where(F.col("fmt") != "sharegpt")
    pairs = to_pair(singles, fmt, cfg.system_prompt, cfg.strict_pair).withColumn(
        "over_length", F.lit(False)
    )
    return (pairs if expanded is None else pairs.unionByName(expanded)), fmt


def expanded_pairs(dialogues: DataFrame, cfg: PrepareConfig) -> DataFrame:
    """Replace ``raw``, a dialogue record, by one row per assistant turn with ``turn_pos``.

    The rows have the columns of ``to_pair`` and ``over_length``. A record with
    a broken turn, or that is no object, gives one row with ``error``.
    """
    others = [c for c in dialogues.columns if c != "raw"]
    turns = messages(F.col("raw"), "sharegpt")
    # Stands for a broken record: expands to one example without a response.
    broken = F.array(
        F.struct(F.lit("user").alias("role"), F.lit("").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content")),
    )
    parsed = dialogues.withColumn("_broken", ~is_object(F.col("raw")))
    said = with_once(parsed, "_turns", turns).select(
        *others,
        F.when(F.col("_broken") | broken_turns(F.col("_turns")), broken)
        .otherwise(F.col("_turns"))
        .alias("_turns"),
    )
    return expand_dialogues(said, "_turns", prompt_limit(cfg), cfg.labels).select(
        *others,
        "turn_pos",
        "prompt",
        "response",
        F.lit(cfg.system_prompt).alias("system"),
        F.lit("").alias("cot"),
        F.col("response").isNull().alias("error"),
        "over_length",
    )


def _turn_key(cfg: PrepareConfig, key: Column, pos: Column) -> Column:
    if cfg.shuffle:
        return F.md5(F.concat_ws("-", key, pos))
    return F.concat(key, F.lpad(F.hex(pos), 16, "0"))


def prepare_turns(turns: DataFrame, cfg: PrepareConfig = PrepareConfig()) -> DataFrame:
    """A turn table to ``conv_id, turn, prompt, response, system, cot, text, split``."""
    return finish(turn_examples(turns, cfg), cfg)


def prepare_documents(docs: DataFrame, cfg: PrepareConfig = PrepareConfig()) -> DataFrame:
    """A plain-text table to ``doc_id, …, text, split``."""
    return finish(document_examples(docs, cfg), cfg)


def leading_format(spark: SparkSession, path: str | list[str]) -> str:
    """Layout of the first record in path order, reading little else.

    The first file is read up to its first valid record. If there is none in its
    first block, the leading files are read: two, then four more, and so on.
    """
    files = scan_files(spark, path)
    head = (
        read_records(spark, files[:1])
        .where((F.col("block_start") == 0) & F.col("raw").isNotNull())
        .limit(1)
    )
    found = first_format(head, "rid")
    start, step = 0, 2
    while found is None and start < len(files):
        chunk = read_records(spark, files[start : start + step])
        found = first_format(chunk, "path", "block_start", "rid")
        start, step = start + step, step * 2
    return found or NO_RECORD_FORMAT


def prepare(
    spark: SparkSession, path: str | list[str], cfg: PrepareConfig = PrepareConfig()
) -> tuple[DataFrame, str | None]:
    """A folder of record files to split examples, and the layout found.

    In the default mode the layout is that of the first record in path order,
    for which the leading file is read up to that record.
    """
    fmt = None
    if cfg.format_mode == "first":
        fmt = leading_format(spark, path)
    examples, fmt = record_examples(read_records(spark, path), cfg, fmt)
    prepared = finish(examples, cfg)
    if prepared.isEmpty():
        raise ValueError(f"no valid example below {path}")
    return prepared, fmt


def split_counts(examples: DataFrame) -> DataFrame:
    """Rows per split."""
    return examples.groupBy("split").agg(F.count("*").alias("n"))


def format_label(fmt: str) -> str:
    """Display name of a layout."""
    return FORMAT_NAMES.get(fmt, fmt)


def with_labels(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """Attach the label text to each labelled document: the response of a classification example."""
    return docs.join(labels.select(key, F.col(label).cast("string").alias("label")), key)
