"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomset.llm import attention_lm, byte_pairs, code_index, mixture, periods, perspectives, pieces, quality_rules, simhash, suffix_dedup, toxicity, va_file, wrappers
from loomset.llm.words import count_words
from loomset.storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query
def op1_mixture(spark, sf):
    """Words each document gives to a mix of all sources."""
    docs = table(spark, sf, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    sized = materialise(docs, "sizes")
    planned = mixture.plan(sized, sized.select("source", "size"))
    return planned.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query
def op5_quality_rules(spark, sf):
    """Counts and verdict of the quality rules for every document."""
    judged = quality_rules.judge(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op8_simhash(spark, sf):
    """The near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op7_suffix_dedup(spark, sf):
    """What is left of every document without byte strings of 400 that repeat."""
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op4_pieces(spark, sf):
    """Piece ids of every document, and whether decoding gives back its text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pieces.encode(docs, exact="exact").select("doc_id", "n_pieces", "ids", "exact")


@query
def op6_toxicity(spark, sf):
    """How toxic every document is, learned from the labelled ones outside the held-out fold."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


@query
def op10_attention_lm(spark, sf):
    """Log chances of every document, by a model learned from those outside the held-out fold."""
    return attention_lm.log_chances(table(spark, sf, "documents"))


@query
def op9_code_index(spark, sf):
    """The 20 nearest vectors of every twentieth one."""
    return code_index.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_perspectives(spark, sf):
    """Every dialogue from the view of each participant."""
    return perspectives.rotate(table(spark, sf, "conversations"))


@query
def op2_wrappers(spark, sf):
    """The main text of every page."""
    return wrappers.extract(table(spark, sf, "pages"))


@query
def op11_byte_pairs(spark, sf):
    """How many tokens every document has, and digests of their ids and of what these decode to."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    decoded = byte_pairs.encode(docs, decoded="decoded", digest="ids_sha256")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_periods(spark, sf):
    """Periodic runs of words of every document, the longest of them, and digests of all and of the collapsed text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    planted = docs.withColumn("text", periods.with_planted_period(F.col("text"), F.col("doc_id")))
    found = periods.collapse_runs(planted)
    top = periods.longest_run()
    return found.select(
        "doc_id",
        F.size("run_start").cast("bigint").alias("n_runs"),
        *[top[c].alias(c) for c in ("start", "length", "period")],
        F.floor(top["length"] * 1000 / top["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(periods.listed(), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_va_file(spark, sf):
    """The cluster of every embedding after three rounds, and what its cluster and centroid are like."""
    found, centroids = va_file.cluster(table(spark, sf, "embeddings"))
    return va_file.with_inertia(found, centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
