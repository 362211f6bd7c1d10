"""A corpus in five stages, from raw documents to the ids a training job reads.

Every stage takes the documents its predecessor kept, written as Parquet and
read again, and returns those it keeps; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.llm import mixture, pieces, quality_rules, simhash, suffix_dedup
from loomset.llm.catalog import table
from loomset.storage import materialise


def quality(spark, docs, sf_dir):
    """Documents that pass every quality rule."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of every group of near-duplicates, that of the smallest id."""
    return simhash.keep_one(docs)


# Half of the passages of 50 words and more that documents of the given tables share have under 400 bytes, 3 % under this.
PASSAGE_BYTES = 200
PASSAGE_GRAM = 64


def repeats(spark, docs, sf_dir):
    """Documents without the passages they share; those of which nothing is left go. NULL texts become empty."""
    return suffix_dedup.drop_repeats(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM).withColumn("n_chars", F.char_length("text").cast("bigint"))


def weighted_mix(spark, docs, sf_dir):
    """Every document as often as the target of its source asks for."""
    return mixture.mix(docs)


def to_ids(spark, docs, sf_dir):
    """The piece ids of every document."""
    return pieces.encode(docs.select("doc_id", "text", "lang", "source")).drop("text")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing to target weights", weighted_mix),
    ("SentencePiece encoding", to_ids),
]

# Blockwise suffix order and a Viterbi search over pieces have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn over ``documents``: (doc_id, lang, source, ids, n_pieces), a row per emitted copy."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
