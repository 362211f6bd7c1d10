"""The registered queries: one callable (spark, sf_dir) → DataFrame per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset import sinks
from loomset.catalog import inputs
from loomset.functions.ratings import memory_grade, speed_rating
from loomset.functions.render import chat_messages, render, render_chat
from loomset.functions.text import TOKENIZERS, py_strip, solid_length, words
from loomset.operators import (
    bertscore as matching,
    curves,
    dialogues,
    formats,
    ordering,
    polyfit,
    preview as previews,
    quality,
    telemetry,
    textscore,
    tokens as token_ops,
)
from loomset.plans import evaluate as evaluation, prepare as plans
from loomset.sources import records as files
from loomset.sources.metrics import read_metrics
from loomset.storage import scratch_path
from loomset.streaming import examples as example_streams, telemetry as telemetry_streams
from loomset.streaming.run import drain, drain_all
from loomset.streaming.runs import state_on_disk, stream_runs as runs_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SYSTEM = plans.SYSTEM_PROMPT


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- sources -----------------------------------------------------------------


def _alpaca(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.documents(spark, sf).select(
        "doc_id",
        F.col("lang").alias("instruction"),
        F.col("source").alias("input"),
        F.col("text").alias("output"),
    )


def _alpaca_pairs(records: DataFrame) -> DataFrame:
    return formats.to_pair(records, "alpaca", SYSTEM).select("prompt", "response")


@query
def read_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    _alpaca(spark, sf).drop("doc_id").write.json(path)
    return _alpaca_pairs(files.read_jsonl(spark, path, suffix="json"))


@query
def read_json(spark, sf):
    """Documents written as files ``{"data": [...]}`` of up to 1,024 records."""
    path = scratch_path(spark, "json")
    rows = _alpaca(spark, sf).withColumn("part", F.floor(F.col("doc_id") / 1024))
    rows.groupBy("part").agg(
        F.collect_list(F.struct("instruction", "input", "output")).alias("data")
    ).write.partitionBy("part").json(path)
    return _alpaca_pairs(files.read_json(spark, path))


def _csv_round_trip(spark, sf, suffix: str, sep: str) -> DataFrame:
    path = scratch_path(spark, suffix)
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "extension": suffix}
    rows = _alpaca(spark, sf)
    # Two header orders below one folder: cells must follow their own file's header.
    for part, columns in (
        (F.col("instruction") == "en", ("instruction", "input", "output")),
        (F.col("instruction") != "en", ("output", "instruction", "input")),
    ):
        rows.where(part).select(*columns).write.mode("append").options(**options).csv(path)
    return _alpaca_pairs(files.read_csv(spark, path, suffix, sep))


@query
def read_csv(spark, sf):
    return _csv_round_trip(spark, sf, "csv", ",")


@query
def read_tsv(spark, sf):
    return _csv_round_trip(spark, sf, "tsv", "\t")


@query
def read_txt(spark, sf):
    path = scratch_path(spark, "txt")
    inputs.documents(spark, sf).select("text").write.option("lineSep", "\n\n").text(path)
    return files.read_txt(spark, path).select(formats.field(F.col("raw"), "text").alias("text"))


@query
def read_mixed_folder(spark, sf):
    """JSON, text and CSV files below one folder, one scan; rows per kind and layout."""
    path = scratch_path(spark, "mixed")
    rows = _alpaca(spark, sf)
    rows.groupBy(F.floor(F.col("doc_id") / 1024).alias("part")).agg(
        F.collect_list(F.struct("instruction", "input", "output")).alias("data")
    ).write.partitionBy("part").json(f"{path}/json")
    rows.select("output").write.option("lineSep", "\n\n").text(f"{path}/txt")
    rows.drop("doc_id").write.options(header=True, quote='"', escape='"').csv(f"{path}/csv")
    found = formats.detect_format(files.read_records(spark, path), "per_file")
    kind = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    return found.groupBy(kind.alias("kind"), "fmt").agg(F.count("*").alias("n"))


@query
def read_metric_maps(spark, sf):
    path = scratch_path(spark, "metrics")
    sinks.write_metric_maps(inputs.metrics(spark, sf), path)
    read = read_metrics(spark, path, "maps")
    return read.withColumn("run_id", F.col("run_id").cast("bigint"))


# --- layouts and dialogues -----------------------------------------------------


@query
def detect_format(spark, sf):
    found = formats.detect_format(inputs.records(spark, sf), "per_record")
    return found.select("doc_id", "fmt", formats.format_name(F.col("fmt")).alias("shown"))


@query
def detect_format_first(spark, sf):
    """Layout of each source's first document, counted over the source."""
    rows = inputs.records(spark, sf).withColumnRenamed("source", "path")
    found = formats.detect_format(rows, "per_file", ("path", "doc_id"))
    return found.groupBy(F.col("path").alias("source"), "fmt").agg(F.count("*").alias("n"))


@query
def to_pair(spark, sf):
    typed = formats.detect_format(inputs.records(spark, sf), "per_record")
    return formats.to_pair(typed, None, SYSTEM).select(
        "doc_id", "prompt", "response", "system", "cot", "error"
    )


@query
def dialogue_expand(spark, sf):
    return dialogues.expand_turns(inputs.turns(spark, sf))


@query
def dialogue_expand_nested(spark, sf):
    return dialogues.expand_dialogues(inputs.dialogue_records(spark, sf), "messages").withColumn(
        "turn_pos", F.col("turn_pos").cast("bigint")
    )


@query
def chatml_pair(spark, sf):
    return dialogues.last_pair(inputs.turns(spark, sf))


@query
def role_map(spark, sf):
    renamed = F.when(F.col("role") == "user", "human").when(
        F.col("role") == "assistant", "gpt"
    ).otherwise(F.col("role"))
    return inputs.turns(spark, sf).select("conv_id", "turn", dialogues.map_role(renamed).alias("role"))


# --- rendering -----------------------------------------------------------------


def _exchange_text(task: str, spark, sf) -> DataFrame:
    text = render(task, F.col("prompt"), F.col("response"), F.lit(SYSTEM), F.lit(""))
    return inputs.exchanges(spark, sf).select("conv_id", "turn", text.alias("text"))


@query
def render_instruction(spark, sf):
    return _exchange_text("instruction", spark, sf)


@query
def render_completion(spark, sf):
    return _exchange_text("text_completion", spark, sf)


@query
def render_cot(spark, sf):
    """English documents reason in their text; the others have no reasoning."""
    cot = F.when(F.col("lang") == "en", F.col("text")).otherwise("")
    text = render("cot", F.col("source"), F.col("lang"), F.lit(SYSTEM), cot)
    return inputs.documents(spark, sf).select("doc_id", text.alias("text"))


@query
def render_chat_template(spark, sf):
    parts = (F.col("prompt"), F.col("response"), F.lit(SYSTEM), F.lit(""))
    text = render_chat(chat_messages("instruction", *parts), add_generation_prompt=True)
    return inputs.exchanges(spark, sf).select("conv_id", "turn", text.alias("text"))


@query
def classification_examples(spark, sf):
    labelled = plans.with_labels(
        inputs.documents(spark, sf), inputs.table(spark, sf, "labels"), "quality"
    )
    text = render("classification", F.col("text"), F.col("label"), F.lit(SYSTEM), F.lit(""))
    return labelled.select("doc_id", text.alias("text"))


# --- quality, dedup, split -------------------------------------------------------


def _stripped(spark, sf) -> DataFrame:
    return inputs.documents(spark, sf).select("doc_id", py_strip(F.col("text")).alias("text"))


@query
def text_measures(spark, sf):
    return _stripped(spark, sf).select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        solid_length(F.col("text")).cast("bigint").alias("n_solid"),
        F.size(words(F.col("text"))).cast("bigint").alias("n_words"),
    )


@query
def quality_rows(spark, sf):
    return quality.quality(_stripped(spark, sf)).select("doc_id", "reject_reason")


@query
def quality_report(spark, sf):
    return quality.quality_report(quality.quality(_stripped(spark, sf)))


@query
def dedup_prefix(spark, sf):
    keyed = _stripped(spark, sf).withColumn("order_key", ordering.order_key(F.col("doc_id")))
    return quality.dedup_prefix(keyed, "order_key").select("doc_id", "order_key")


@query
def split_exact(spark, sf):
    keyed = inputs.documents(spark, sf).select(
        "doc_id", ordering.order_key(F.col("doc_id")).alias("order_key")
    )
    return ordering.split_exact(keyed, "order_key", 0.05).select("doc_id", "split")


@query
def test_set_tail(spark, sf):
    """No validation rows: the last tenth of the training rows."""
    rows = inputs.documents(spark, sf).select(
        "doc_id",
        ordering.order_key(F.col("doc_id")).alias("order_key"),
        F.lit("train").alias("split"),
    )
    return ordering.test_set(rows, "order_key").select("doc_id")


@query
def test_set_repeated(spark, sf):
    """Keys that many rows share: the held-out tail still has its exact size."""
    rows = inputs.documents(spark, sf).select(
        "doc_id", ordering.order_key(F.col("lang")).alias("order_key")
    )
    whole = ordering.split_exact(rows, "order_key").withColumn("split", F.lit("train"))
    return ordering.test_set(whole, "order_key").agg(F.count("*").alias("n"))


@query
def seeded_rank(spark, sf):
    keyed = inputs.documents(spark, sf).select(
        "doc_id", ordering.order_key(F.col("doc_id")).alias("order_key")
    )
    return ordering.ranked(keyed, "order_key").select("doc_id", "rank")


@query
def head_rows(spark, sf):
    """The first rows in seeded order: a top-n report."""
    keyed = inputs.documents(spark, sf).select(
        "doc_id", ordering.order_key(F.col("doc_id")).alias("order_key")
    )
    return ordering.head(keyed, 20, "order_key")


@query
def prepared_documents(spark, sf):
    return plans.prepare_documents(inputs.documents(spark, sf)).select("doc_id", "text", "split")


@query
def prepared_turns(spark, sf):
    return plans.prepare_turns(inputs.turns(spark, sf)).select(
        "conv_id", "turn", "prompt", "response", "text", "split"
    )


def _prepared_turns(spark, sf, **settings) -> DataFrame:
    rows = plans.prepare_turns(inputs.turns(spark, sf), plans.PrepareConfig(**settings))
    return rows.select("conv_id", "turn", "prompt", "text", "split")


@query
def prepared_turns_cot(spark, sf):
    """Without reasoning the text is the response, however long its prompt."""
    return _prepared_turns(spark, sf, task_type="cot")


@query
def prepared_turns_completion(spark, sf):
    return _prepared_turns(spark, sf, task_type="text_completion")


@query
def prepared_turns_unchecked(spark, sf):
    """No length rules: examples of any length stay."""
    return _prepared_turns(spark, sf, quality_check=False)


@query
def prepared_broken_files(spark, sf):
    """Files whose first lines are malformed have the layout of their first valid record."""
    path = scratch_path(spark, "broken")
    rows = _alpaca(spark, sf).drop("doc_id")
    rows.select(F.concat(F.lit("{broken\n\n[1,\n"), F.to_json(F.struct("*")))).write.text(path)
    records = files.read_jsonl(spark, path, suffix="txt")
    found = formats.detect_format(records, "first").where("fmt = 'alpaca'")
    pairs = formats.to_pair(found, "alpaca", SYSTEM)
    return pairs.select("error", F.when(~F.col("error"), F.col("prompt")).alias("prompt"), "response")


@query
def prepared_files(spark, sf):
    """From record files through layout detection, rules and dedup to the split sizes."""
    path = scratch_path(spark, "prepared")
    rows = _alpaca(spark, sf)
    rows.drop("doc_id").write.options(header=True, quote='"', escape='"').csv(path)
    examples, _ = plans.prepare(spark, path)
    return plans.split_counts(examples)


@query
def prepared_dialogue_files(spark, sf):
    """Dialogue records (lines of a document, spoken in turn) from files to the split sizes."""
    path = scratch_path(spark, "dialogues")
    message = F.transform(
        "messages",
        lambda m: F.struct(
            F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"),
            m["content"].alias("value"),
        ),
    )
    rows = inputs.dialogue_records(spark, sf).select(message.alias("conversations"))
    rows.write.json(path)
    records = files.read_jsonl(spark, path, suffix="json")
    cfg = plans.PrepareConfig(dedup_on="pair")
    examples, _ = plans.record_examples(records, cfg)
    return plans.split_counts(plans.finish(examples, cfg))


@query
def rejected_dialogue_examples(spark, sf):
    """Reasons for which expanded examples are left out, with those never rendered."""
    cfg = plans.PrepareConfig(max_length=1000)
    examples = plans.turn_examples(inputs.turns(spark, sf), cfg)
    return quality.quality_report(plans.judged(examples, cfg))


@query
def prepared_chat_template(spark, sf):
    cfg = plans.PrepareConfig(chat_template=True, dedup=False)
    clean = plans.clean(plans.turn_examples(inputs.turns(spark, sf), cfg), cfg)
    return clean.select("conv_id", "turn", "text")


@query
def written_examples(spark, sf):
    """Prepared documents written by split and read back."""
    path = scratch_path(spark, "examples")
    sinks.write_examples(plans.prepare_documents(inputs.documents(spark, sf)), path)
    return spark.read.parquet(path).select("doc_id", "split")


@query
def run_manifest(spark, sf):
    cfg = plans.PrepareConfig()
    row = sinks.manifest(plans.prepare_documents(inputs.documents(spark, sf), cfg), cfg, "plain_text")
    return row.select("task_type", "dataset_format", "n_train", "n_val")


@query
def preview(spark, sf):
    return previews.preview_groups(
        inputs.records(spark, sf), "source", F.col("doc_id"), F.col("raw"), F.col("json")
    ).select("source", "n", "fmt", "keys", "head")


# --- training curves -------------------------------------------------------------


@query
def loss_summary(spark, sf):
    summary = curves.loss_summary(inputs.metrics(spark, sf))
    return _rounded(summary, 6, "reduction_pct")


@query
def loss_curves(spark, sf):
    return curves.curves(inputs.metrics(spark, sf))


@query
def early_stop(spark, sf):
    return curves.early_stop(inputs.metrics(spark, sf))


@query
def poly_fit(spark, sf):
    _, fits = polyfit.poly_fit(inputs.points(spark, sf))
    return _rounded(fits, 6, "r2").select(
        "run_id", F.col("degree").cast("bigint").alias("degree"), "n_points", "r2"
    )


@query
def poly_fit_curve(spark, sf):
    fitted, _ = polyfit.poly_fit(inputs.points(spark, sf))
    return _rounded(fitted, 4, "fitted").select("run_id", "step", "fitted")


@query
def poly_fit_linear(spark, sf):
    _, fits = polyfit.poly_fit(inputs.points(spark, sf), degree=1)
    coefficients = polyfit.step_coefficients(fits)
    return coefficients.select(
        "run_id",
        F.round(F.col("step_coefficients")[0], 6).alias("slope"),
        F.round(F.col("step_coefficients")[1], 4).alias("intercept"),
        F.round("r2", 6).alias("r2"),
    )


# --- scores ----------------------------------------------------------------------


@query
def scoreable_pairs(spark, sf):
    rows = inputs.documents(spark, sf).select(
        "doc_id", F.col("source").alias("instruction"), F.col("text").alias("output")
    )
    return textscore.scoreable(rows).select("doc_id", "prompt", "reference")


@query
def pair_up(spark, sf):
    said = inputs.exchanges(spark, sf).withColumn("pair_id", F.concat_ws("-", "conv_id", "turn"))
    return textscore.pair_up(
        said.select("pair_id", F.col("response").alias("prediction")),
        said.select("pair_id", F.col("prompt").alias("reference")),
    ).select("pair_id", "reference", "prediction")


@query
def rouge_n(spark, sf):
    scores = textscore.rouge(inputs.pairs(spark, sf))
    return _rounded(scores, 6, "rouge_1", "rouge_2").select("pair_id", "rouge_1", "rouge_2")


@query
def rouge_n_counted(spark, sf):
    scores = textscore.rouge(inputs.pairs(spark, sf), distinct_ngrams=False)
    return _rounded(scores, 6, "rouge_1", "rouge_2").select("pair_id", "rouge_1", "rouge_2")


@query
def rouge_l(spark, sf):
    scores = textscore.rouge(inputs.pairs(spark, sf))
    return _rounded(scores, 6, "rouge_l").select("pair_id", "rouge_l")


@query
def rouge_corpus(spark, sf):
    return textscore.corpus_mean(
        textscore.rouge(inputs.pairs(spark, sf)), "rouge_1", "rouge_2"
    )


@query
def word_rules(spark, sf):
    counts = [F.size(words(F.col("text"), t)).cast("bigint").alias(t) for t in TOKENIZERS]
    return inputs.documents(spark, sf).select("doc_id", *counts)


@query
def bertscore(spark, sf):
    names = ("bertscore_precision", "bertscore_recall", "bertscore_f1")
    return _rounded(matching.bertscore(inputs.token_vectors(spark, sf)), 5, *names)


@query
def written_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(inputs.pairs(spark, sf), path)
    schema = "pair_id STRING, prompt STRING, reference STRING, prediction STRING"
    return spark.read.schema(schema).json(path)


@query
def written_samples(spark, sf):
    """Requests written with their performance nested, and read back flat."""
    path = scratch_path(spark, "samples")
    requests = inputs.requests(spark, sf)
    performance = telemetry.request_performance(
        requests, inputs.tokens(spark, sf), inputs.samples(spark, sf)
    )
    sinks.write_samples(requests.select("request_id"), performance, path)
    schema = "request_id STRING, performance STRUCT<output_tokens: BIGINT, gpu_memory_peak: DOUBLE>"
    return spark.read.schema(schema).json(path).select("request_id", "performance.*")


@query
def eval_loss(spark, sf):
    return textscore.eval_loss(inputs.token_logprobs(spark, sf))


@query
def score_report(spark, sf):
    return evaluation.evaluate(
        inputs.report_pairs(spark, sf),
        inputs.token_vectors(spark, sf),
        inputs.report_logprobs(spark, sf),
    )


@query
def held_out_report(spark, sf):
    """From turns to the report of the held-out examples; every other answer is predicted, the rest not said."""
    pair_id = F.concat_ws("-", "conv_id", "turn").alias("pair_id")
    examples = plans.prepare_turns(inputs.turns(spark, sf)).select(
        pair_id, "prompt", "response", "order_key", "split"
    )
    said = inputs.turns(spark, sf).select(
        pair_id, F.when(F.col("turn") % 4 < 2, F.col("text")).alias("prediction")
    )
    return evaluation.evaluate_held_out(examples, said).select("num_samples", "rouge_1", "rouge_l")


# --- token columns ---------------------------------------------------------------


def _joined(column: str) -> Column:
    return F.array_join(column, " ")


@query
def token_columns(spark, sf):
    rows = token_ops.token_columns(inputs.documents(spark, sf).select("doc_id", "text"))
    return rows.select(
        "doc_id",
        _joined("input_ids").alias("input_ids"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        "truncated",
    )


def _code_points(texts: list[str]) -> list[list[int]]:
    return [[ord(c) for c in text] for text in texts]


@query
def model_token_columns(spark, sf):
    """Token columns of an encoder handed in by the user; here characters."""
    rows = token_ops.token_columns(
        inputs.turns(spark, sf), 256, token_ops.model_tokenizer(_code_points)
    )
    return rows.select(
        "conv_id",
        "turn",
        _joined("input_ids").alias("input_ids"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        "truncated",
    )


@query
def masked_labels(spark, sf):
    """Labels of question and answer in one text; the question carries no loss."""
    rows = inputs.exchanges(spark, sf).select(
        "conv_id",
        "turn",
        F.octet_length("prompt").alias("prompt_len"),
        F.concat("prompt", "response").alias("text"),
    )
    masked = token_ops.token_columns(rows, prompt_len="prompt_len")
    return masked.select("conv_id", "turn", _joined("labels").alias("labels"))


@query
def padded_batches(spark, sf):
    """Batches of eight documents, padded; per batch its width and real tokens."""
    rows = inputs.documents(spark, sf).select(
        "doc_id", "text", ordering.order_key(F.col("doc_id")).alias("order_key")
    )
    padded = token_ops.pad_batches(token_ops.token_columns(rows), 8, 0)
    real = F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x)
    return padded.select(
        "doc_id",
        "batch",
        F.size("input_ids").cast("bigint").alias("width"),
        real.cast("bigint").alias("n_real"),
    )


def _bucketed(spark, sf) -> DataFrame:
    rows = inputs.documents(spark, sf).select("doc_id", "text")
    return token_ops.bucket_batches(token_ops.token_columns(rows), 8, 0)


@query
def bucketed_batches(spark, sf):
    """Documents padded to the width of their length bucket; none moves."""
    real = F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x)
    return _bucketed(spark, sf).select(
        "doc_id", "width", F.size("labels").cast("bigint").alias("n_places"), real.cast("bigint").alias("n_real")
    )


@query
def padding_by_width(spark, sf):
    """How much padding length buckets need."""
    return token_ops.padding_report(_bucketed(spark, sf))


# --- telemetry -------------------------------------------------------------------

_SPEEDS = (
    "total_inference_time",
    "first_token_latency",
    "pure_generation_time",
    "total_inference_speed",
    "overall_processing_speed",
    "pure_generation_speed",
    "response_speed",
    "real_time_avg_speed",
)


@query
def speeds(spark, sf):
    rows = telemetry.speeds(inputs.requests(spark, sf), inputs.tokens(spark, sf))
    return _rounded(rows, 8, *_SPEEDS)


@query
def token_gaps(spark, sf):
    return _rounded(telemetry.token_gaps(inputs.tokens(spark, sf)), 6, "gap").select(
        "request_id", F.unix_micros("ts").alias("us"), "gap"
    )


@query
def resource_summary(spark, sf):
    rows = telemetry.resource_summary(inputs.samples(spark, sf), inputs.baseline(spark, sf))
    return _rounded(rows, 8, *[c for c in rows.columns if c not in ("request_id", "n_samples")])


@query
def memory_analysis(spark, sf):
    rows = telemetry.memory_analysis(inputs.samples(spark, sf), inputs.baseline(spark, sf))
    numbers = (
        "system_memory_peak", "pytorch_memory_peak", "gpu_memory_peak", "system_memory_variance",
        "pytorch_memory_variance", "model_memory_footprint", "memory_utilisation_pct",
    )
    return _rounded(rows, 8, *numbers)


@query
def request_performance(spark, sf):
    rows = telemetry.request_performance(
        inputs.requests(spark, sf), inputs.tokens(spark, sf), inputs.samples(spark, sf)
    )
    whole = ("request_id", "input_tokens", "output_tokens")
    return _rounded(rows, 8, *[c for c in rows.columns if c not in whole])


@query
def suggestions(spark, sf):
    samples, base = inputs.samples(spark, sf), inputs.baseline(spark, sf)
    rows = telemetry.request_suggestions(
        telemetry.speeds(inputs.requests(spark, sf), inputs.tokens(spark, sf)),
        telemetry.resource_summary(samples, base),
        telemetry.memory_analysis(samples, base),
    )
    return rows.select("request_id", F.array_join("suggestions", "; ").alias("suggestions"))


@query
def ratings(spark, sf):
    return inputs.table(spark, sf, "events").select(
        "event_id",
        speed_rating(F.col("value")).alias("rating"),
        memory_grade(F.col("value") / 10).alias("grade"),
    )


_GAP = 6 * 3600


def _session_input(df: DataFrame) -> DataFrame:
    return inputs.with_samples(df, F.col("user_id"))


@query
def sessions(spark, sf):
    rows = telemetry.session_summary(_session_input(inputs.events(spark, sf)), _GAP)
    return _session_columns(rows)


def _session_columns(rows: DataFrame) -> DataFrame:
    rounded = ("cpu_avg", "gpu_temp_avg", "gpu_memory_avg", "system_memory_variance")
    return _rounded(rows, 6, *rounded).select(
        "request_id",
        F.unix_micros("session_start").alias("start_us"),
        F.unix_micros("session_end").alias("end_us"),
        "n_samples",
        "cpu_avg",
        "cpu_max",
        "cpu_min",
        "gpu_temp_avg",
        "gpu_memory_avg",
        "system_memory_peak",
        "system_memory_trend",
        "system_memory_variance",
    )


# --- streams ---------------------------------------------------------------------


@query
def stream_snapshots(spark, sf):
    samples = _session_input(inputs.event_stream(spark, sf))
    return drain_all(samples, telemetry_streams.stream_snapshots, "snapshots").select(
        "request_id",
        F.unix_micros("window_start").alias("window_us"),
        F.unix_micros("ts").alias("us"),
        "cpu",
        "system_memory",
    )


@query
def stream_resources(spark, sf):
    def build(samples: DataFrame) -> DataFrame:
        return telemetry_streams.stream_resources(samples, f"{_GAP} seconds", "10 seconds")

    samples = _session_input(inputs.event_stream(spark, sf))
    return _session_columns(drain_all(samples, build, "resources"))


@query
def stream_requests(spark, sf):
    tokens = inputs.event_stream(spark, sf).select(
        F.col("user_id").alias("request_id"),
        "ts",
        F.date_trunc("day", "ts").alias("start_ts"),
        inputs._k().cast("bigint").alias("input_tokens"),
    )

    def build(tokens: DataFrame) -> DataFrame:
        return telemetry_streams.stream_requests(tokens, f"{_GAP} seconds", "10 seconds")

    return _rounded(drain_all(tokens, build, "requests"), 8, *_SPEEDS)


@query
def stream_examples(spark, sf):
    records = inputs.document_stream(spark, sf).select(
        "doc_id", F.try_parse_json(F.to_json(F.struct("text"))).alias("raw")
    )
    stream = example_streams.stream_examples(records, fmt="plain_text").select("doc_id", "text")
    return drain(stream, "stream-examples")


@query
def stream_dedup(spark, sf):
    """First arrivals of each event text; the key set does not depend on the arrival order."""
    texts = inputs.event_stream(spark, sf).select(
        "ts", F.concat_ws(" ", "event_type", "props").alias("text")
    )
    return drain(example_streams.stream_dedup(texts, delay="365 days"), "dedup").select("text")


def _reset_input(df: DataFrame) -> DataFrame:
    """Events as samples, of which signups are resets."""
    return df.select(
        F.col("user_id").alias("request_id"),
        "ts",
        (F.col("event_type") == "signup").alias("reset"),
        F.col("value").alias("cpu"),
        (inputs._k() / 10).alias("system_memory"),
    )


def _run_columns(rows: DataFrame) -> DataFrame:
    return _rounded(rows, 6, "cpu_avg", "sample_speed").select(
        "request_id",
        F.unix_micros("run_start").alias("start_us"),
        F.unix_micros("run_end").alias("end_us"),
        "n_samples",
        "cpu_avg",
        "cpu_max",
        "system_memory_peak",
        "sample_speed",
    )


@query
def reset_runs(spark, sf):
    return _run_columns(telemetry.run_summary(_reset_input(inputs.events(spark, sf)), _GAP))


@query
def stream_reset_runs(spark, sf):
    def build(samples: DataFrame) -> DataFrame:
        return runs_of(samples, _GAP, "10 seconds")

    with state_on_disk(spark):
        return _run_columns(drain_all(_reset_input(inputs.event_stream(spark, sf)), build, "runs"))


@query
def stream_dedup_first(spark, sf):
    texts = inputs.event_stream(spark, sf).select(
        "event_id", "ts", F.concat_ws(" ", "event_type", "props").alias("text"), ordering.order_key(F.col("event_id")).alias("order_key")
    )

    def build(rows: DataFrame) -> DataFrame:
        return example_streams.stream_dedup_first(rows, "order_key", delay="365 days")

    return drain_all(texts, build, "dedup-first").select("event_id", "order_key", "text")
