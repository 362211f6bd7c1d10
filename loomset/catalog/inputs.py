"""The inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomset.functions.text import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a TIMESTAMP time: the file has none, it is read in the session zone, UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files.

    A plain path of a stream has to be a folder; a pattern, here one of a
    single match, may stand for either.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = table_stream(spark, sf_dir, "events")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "documents")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right behind it: ``conv_id, turn, prompt, response``."""
    all_turns = turns(spark, sf_dir)
    asked = all_turns.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    said = all_turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("response")
    )
    return asked.join(said, ["conv_id", "turn"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges as scored pairs: the answer is the prediction, the question the reference."""
    return exchanges(spark, sf_dir).select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"),
        "prompt",
        F.col("prompt").alias("reference"),
        F.col("response").alias("prediction"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON records whose layout depends on their source: ``doc_id, json, raw``."""
    text, lang, source = F.col("text"), F.col("lang"), F.col("source")

    def said(speaker: str, who: str, body: str, what: Column) -> Column:
        return F.struct(F.lit(who).alias(speaker), what.alias(body))

    shapes = {
        "src0": F.struct(lang.alias("instruction"), source.alias("input"), text.alias("output")),
        "src1": F.struct(
            F.array(
                said("from", "human", "value", lang), said("from", "gpt", "value", text)
            ).alias("conversations")
        ),
        "src2": F.struct(
            F.array(
                said("role", "system", "content", lang),
                said("role", "user", "content", source),
                said("role", "assistant", "content", text),
            ).alias("messages")
        ),
        "src3": F.struct(
            source.alias("Question"), text.alias("Complex_CoT"), lang.alias("Response")
        ),
        "src4": F.struct(text.alias("text")),
        "src5": F.struct(source.alias("query"), text.alias("answer"), lang.alias("content")),
    }
    json = F.to_json(F.struct(text.alias("content"), source.alias("q")))
    for name, shape in shapes.items():
        json = F.when(source == name, F.to_json(shape)).otherwise(json)
    return documents(spark, sf_dir).select(
        "doc_id", "source", json.alias("json"), F.try_parse_json(json).alias("raw")
    )


def dialogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dialogues: lines are spoken by user and assistant in turn."""
    lines = F.split("text", "\n")
    message = F.transform(
        lines,
        lambda line, i: F.struct(
            F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), line.alias("content")
        ),
    )
    return documents(spark, sf_dir).select("doc_id", message.alias("messages"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training curves: a run per user, the event number as step, a tag per event type."""
    kind = F.col("event_type")
    tag = (
        F.when(kind == "click", "train/loss")
        .when(kind == "purchase", "eval/loss")
        .when(kind == "signup", "train/learning_rate")
        .otherwise("loss")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), tag.alias("tag"), F.col("event_id").alias("step"), "value"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user as one series."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), "value"
    )


def _request_id() -> Column:
    return F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as token arrivals; a request is a user's day."""
    return events(spark, sf_dir).select(
        _request_id().alias("request_id"), "ts", F.col("event_type").alias("chunk")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day: from midnight to the last event."""
    return (
        events(spark, sf_dir)
        .groupBy(_request_id().alias("request_id"), F.date_trunc("day", "ts").alias("start_ts"))
        .agg(
            F.max("ts").alias("end_ts"),
            F.max(_k()).cast("bigint").alias("input_tokens"),
            F.lit(None).cast("bigint").alias("output_tokens"),
        )
    )


def with_samples(df: DataFrame, request: Column) -> DataFrame:
    """Events as resource samples; readings of some event types are missing."""
    kind, k = F.col("event_type"), _k()
    return df.select(
        request.alias("request_id"),
        "ts",
        F.col("value").alias("cpu"),
        (k / 10).alias("system_memory"),
        F.when(kind != "error", k / 8).alias("pytorch_allocated"),
        F.when(kind != "error", k / 8).alias("gpu_memory_allocated"),
        F.when(kind != "signup", k).alias("gpu_usage"),
        F.when(kind == "click", F.col("value")).alias("gpu_temp"),
        F.when(kind == "view", F.col("value") * 2).alias("gpu_power"),
        F.when(kind != "view", k / 7).alias("gpu_memory_used"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_samples(events(spark, sf_dir), _request_id())


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline of a request: midnight, and fixed parts of its largest reading."""
    return requests(spark, sf_dir).select(
        "request_id",
        "start_ts",
        (F.col("input_tokens") / 40).alias("system_memory_used"),
        (F.col("input_tokens") / 20).alias("gpu_memory_allocated"),
        (F.col("input_tokens") / 5).alias("gpu_memory_total"),
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as token vectors: 32 neighbours form a pair of two texts of 16 tokens."""
    number = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(number / 32).alias("pair_id"),
        F.when(number % 32 < 16, "pred").otherwise("ref").alias("side"),
        (number % 16).cast("int").alias("pos"),
        F.col("embedding").alias("vec"),
    )


def report_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pairs to be scored: a quarter has no prompt, a fifth no prediction."""
    number = F.col("doc_id")
    return documents(spark, sf_dir).select(
        number.alias("pair_id"),
        F.when(number % 4 == 3, "").otherwise(F.col("source")).alias("instruction"),
        F.concat_ws(" ", "lang", "source").alias("output"),
        F.when(number % 5 != 0, F.concat_ws(" ", "source", "lang")).alias("prediction"),
    )


def report_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, the first being the prompt, with minus the word's length as log probability."""
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").alias("pair_id"), F.posexplode(words(F.col("text"))).alias("pos", "word")
    )
    return rows.select(
        "pair_id", "pos", F.lit(1).alias("prompt_len"), (-F.length("word")).cast("double").alias("logprob")
    )


def token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of question and answer with a stand-in log probability: minus the word's length."""
    asked, said = words(F.col("prompt")), words(F.col("response"))
    both = exchanges(spark, sf_dir).select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"),
        F.size(asked).alias("prompt_len"),
        F.concat(asked, said).alias("words"),
    )
    rows = both.select("pair_id", "prompt_len", F.posexplode("words").alias("pos", "word"))
    return rows.select(
        "pair_id", "pos", "prompt_len", (-F.length("word")).cast("double").alias("logprob")
    )
