"""Token columns for training: ids, labels, prompt mask, padded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, Window

from loomset.functions.text import GROUP_CHARS, text_groups, utf8_ids
from loomset.operators.ordering import ranked
from loomset.storage import materialise

# Fixed value: the label of a position that carries no loss.
IGNORED = -100

# Batches a task fills at a time.
_HELD = 256

# A row that waits for its batch: other columns, ids, labels, and whether these are its own copies.
Row = tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]
_FIRST = pa.array([0])


def model_tokenizer(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """Wrap a batch encoder (texts → id lists) as an Arrow-batched column function.

    It gets groups of texts of about ``GROUP_CHARS`` bytes in all (a longer text
    ends its group), whose ids leave the task before the next group is read.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for begin, rows in text_groups(sizes, GROUP_CHARS):
                group = pc.fill_null(texts.slice(begin, rows), "").to_pylist()
                yield pa.array(encode(group), pa.list_(pa.int32()))

    return ids


def token_columns(
    df: DataFrame,
    max_len: int = 2048,
    tokenizer: Callable[[Column], Column] | None = None,
    text: str = "text",
    prompt_len: str | None = None,
) -> DataFrame:
    """Replace the text by ``input_ids, labels, n_tokens, truncated``.

    Ids are cut to ``max_len``; ``n_tokens`` counts them before the cut. The
    default ids are the UTF-8 bytes of the text. Labels equal the ids; with
    ``prompt_len`` (a column) the positions of the prompt are ``IGNORED``.
    """
    others = [c for c in df.columns if c != text]
    if tokenizer is None:
        rows = df.select(
            *others,
            utf8_ids(F.col(text), max_len).alias("input_ids"),
            F.octet_length(text).alias("n_tokens"),
        )
    else:
        rows = df.select(*others, tokenizer(F.col(text)).alias("_ids")).select(
            *others,
            F.slice("_ids", 1, max_len).alias("input_ids"),
            F.size("_ids").alias("n_tokens"),
        )
    labels = F.col("input_ids")
    if prompt_len is not None:
        limit = F.col(prompt_len)
        labels = F.transform("input_ids", lambda x, i: F.when(i < limit, IGNORED).otherwise(x))
    return rows.select(
        *others,
        "input_ids",
        labels.alias("labels"),
        "n_tokens",
        (F.col("n_tokens") > max_len).alias("truncated"),
    )


def pad_batches(df: DataFrame, size: int, pad_id: int, key: str = "order_key") -> DataFrame:
    """Batches of ``size`` consecutive rows in order of ``key``, padded to their longest row.

    Adds ``batch`` and ``attention_mask``; pads ``input_ids`` with ``pad_id``
    and ``labels`` with ``IGNORED``. Keys may repeat: rows are written once,
    with a number that breaks ties, so texts are tokenised once. Ranks are
    found on the narrow (key, length) table; the arrays move to their batch.
    """
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    unique = F.concat(F.col(key), F.lpad(F.hex("_row"), 16, "0"))
    narrow = rows.select("_row", unique.alias("_place"), F.size("input_ids").alias("_len"))
    batches = ranked(narrow, "_place").select(
        "_row", F.floor(F.col("rank") / size).alias("batch"), "_len"
    )
    longest = F.max("_len").over(Window.partitionBy("batch"))
    sized = batches.select("_row", "batch", longest.alias("_to"))
    missing = F.col("_to") - F.size("input_ids")

    def padded(name: str, filler: int) -> Column:
        return F.concat(name, F.array_repeat(F.lit(filler), missing))

    others = [c for c in df.columns if c not in ("input_ids", "labels")]
    return rows.join(sized, "_row").select(
        *others,
        "batch",
        padded("input_ids", pad_id).alias("input_ids"),
        padded("labels", IGNORED).alias("labels"),
        F.concat(
            F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), missing)
        ).alias("attention_mask"),
    )


def bucket_of(length: Column, step: int) -> Column:
    """The width a row is padded to: the smallest multiple of ``step`` that holds it, at least one."""
    return F.greatest(F.ceil(length / F.lit(step)), F.lit(1)).cast("bigint") * step


def bucket_batches(df: DataFrame, size: int, pad_id: int, step: int = 64) -> DataFrame:
    """Batches of up to ``size`` rows of one length bucket, padded to its width; no row moves.

    A row goes into the tightest bucket (``bucket_of``), whatever its order, so
    the padding of a row is under ``step`` however lengths are mixed. A task
    fills the buckets of its own partition and hands a batch on when it is full:
    it holds at most ``_HELD`` batches of rows, of which it hands on the fullest
    if texts come in more widths than that. Rows that wait for others are copied
    out of the table they came in, and labels equal to their ids are not sent to
    the task. Adds ``batch`` (unique, rows of one
    stand together), ``width`` and ``attention_mask``, and pads ``input_ids``
    with ``pad_id`` and ``labels`` with ``IGNORED``. NULL arrays count as empty;
    rows stay one to one, and an empty table gives an empty one.
    """
    others = [c for c in df.columns if c not in ("input_ids", "labels", "batch", "width", "attention_mask")]
    ints = F.array().cast("array<int>")
    schema = df.select(
        *others,
        *[ints.alias(c) for c in ("input_ids", "labels", "attention_mask")],
        *[F.lit(0).cast("bigint").alias(c) for c in ("batch", "width")],
    ).schema

    def padded(lists: list[np.ndarray], width: int, filler: int) -> pa.ListArray:
        rows = np.full((len(lists), width), filler, np.int32)
        for row, values in zip(rows, lists, strict=True):
            row[: values.size] = values
        return pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * width, pa.array(rows.ravel()))

    def arrays_of(lists: pa.ListArray) -> Iterator[np.ndarray]:
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for k, here in enumerate(lists.is_valid().to_pylist()):
            yield values[ends[k] : ends[k + 1]] if here else values[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Row]] = {}
        first = TaskContext.get().partitionId() << 33
        made = 0

        def hand_on(width: int) -> pa.RecordBatch:
            nonlocal made
            rows = held.pop(width)
            kept = pa.concat_batches([r[0] for r in rows]).select(others)
            masks = [np.ones(r[1].size, np.int32) for r in rows]
            arrays = [padded([r[1] for r in rows], width, pad_id), padded([r[2] for r in rows], width, IGNORED), padded(masks, width, 0)]
            numbers = [pa.array(np.full(len(rows), n, np.int64)) for n in (first + made, width)]
            made += 1
            return pa.RecordBatch.from_arrays([*kept.columns, *arrays, *numbers], names=schema.names)

        def copied(row: Row) -> Row:
            own, ids, labels, fresh = row
            if fresh:
                return row
            ids_copy = ids.copy()
            return own.take(_FIRST), ids_copy, ids_copy if labels is ids else labels.copy(), True

        for batch in batches:
            own = batch.select(others) if others else pa.RecordBatch.from_arrays([batch.column("_same")], names=["_same"])
            same = batch.column("_same").to_pylist()
            for k, (ids, labels) in enumerate(zip(arrays_of(batch.column("input_ids")), arrays_of(batch.column("labels")), strict=True)):
                labels = ids if same[k] else labels
                width = max(-(-max(ids.size, labels.size) // step), 1) * step
                held.setdefault(width, []).append((own.slice(k, 1), ids, labels, False))
                if len(held[width]) == size:
                    yield hand_on(width)
                elif len(held) > _HELD:
                    yield hand_on(max(held, key=lambda w: len(held[w])))
            for rows in held.values():  # else a row keeps all those it came with
                rows[:] = [copied(row) for row in rows]
        for width in sorted(held):
            yield hand_on(width)

    same = F.col("labels").eqNullSafe(F.col("input_ids"))
    sent = df.select(*others, "input_ids", F.when(~same, F.col("labels")).alias("labels"), same.alias("_same"))
    return sent.mapInArrow(run, schema)


def padding_report(df: DataFrame) -> DataFrame:
    """Per width of padded rows (``input_ids``, ``attention_mask``): rows, real and padded places, share of padding."""
    real = F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x).cast("bigint")
    rows = df.select(F.size("input_ids").cast("bigint").alias("width"), real.alias("n_real"))
    sums = rows.groupBy("width").agg(F.count("*").alias("n_rows"), F.sum("n_real").alias("n_real"))
    places = F.col("n_rows") * F.col("width")
    return sums.select("width", "n_rows", "n_real", (places - F.col("n_real")).alias("n_padding"), F.round(1 - F.col("n_real") / places, 6).alias("share"))
