"""Scores of predictions against references. Pairs: ``pair_id, prompt, reference, prediction``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loomset.functions.lcs import lcs
from loomset.functions.text import py_strip, words

DIGITS = 4


def pair_up(predictions: DataFrame, references: DataFrame, key: str = "pair_id") -> DataFrame:
    """Join predictions and references by key; list positions would shift after a gap."""
    return references.join(predictions, key)


def scoreable(rows: DataFrame) -> DataFrame:
    """Rows that can be evaluated: non-empty prompt and reference.

    A record's prompt is its ``prompt`` or, if it has none (NULL, or no such
    column), its ``instruction``; its reference is ``reference``, ``response``
    or ``output``, the first it has.
    """

    def first_present(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit(""))

    out = rows.withColumn("prompt", first_present("prompt", "instruction")).withColumn(
        "reference", first_present("reference", "response", "output")
    )
    return out.where((F.col("prompt") != "") & (F.col("reference") != ""))


def not_blank(text: Column) -> Column:
    """A blank or missing text is scored as a full stop."""
    given = F.coalesce(text, F.lit(""))
    return F.when(py_strip(given) == "", ".").otherwise(given)


# Joins the words of an n-gram; whitespace, so no word contains it.
_GLUE = "\x1f"


def _grams(tokens: Column, n: int) -> Column:
    """The n-grams (n = 1 or 2) of a word array, in order, as strings."""
    if n == 1:
        return tokens
    count = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), count),
        F.slice(tokens, F.lit(2), count),
        lambda a, b: F.concat_ws(_GLUE, a, b),
    )


def f_score(overlap: Column, n_prediction: Column, n_reference: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without overlap."""
    return F.when(overlap > 0, overlap * 2.0 / (n_prediction + n_reference)).otherwise(0.0)


def rouge(
    pairs: DataFrame,
    tokenizer: str | Callable[[Column], Column] = "whitespace",
    distinct_ngrams: bool = True,
    key: str = "pair_id",
) -> DataFrame:
    """ROUGE-1, ROUGE-2 and ROUGE-L F-scores per pair (Lin 2004, β = 1).

    ``tokenizer`` names a word rule (see ``words``) or maps a text column to array<string>.

    With ``distinct_ngrams`` an n-gram counts once per text, and a pair is
    scored where it stands. Otherwise repeated n-grams match up to the smaller
    count: n-grams are counted per pair by a shuffle on (pair, n-gram).
    ROUGE-L is the longest common subsequence of the whole texts.
    """
    split = tokenizer if callable(tokenizer) else lambda text: words(text, tokenizer)
    tokens = pairs.select(
        key,
        split(not_blank(F.col("prediction"))).alias("p"),
        split(not_blank(F.col("reference"))).alias("r"),
    )
    p, r = F.col("p"), F.col("r")
    scored = tokens.select(
        key, "p", "r", f_score(lcs("p", "r"), F.size("p"), F.size("r")).alias("rouge_l")
    )
    if not distinct_ngrams:
        return scored.select(key, "rouge_l").join(_clipped(tokens, key), key)

    # One row keeps its n-gram sets in columns: every set is built once.
    grams = scored.select(
        key,
        "rouge_l",
        F.array_distinct(p).alias("p1"),
        F.array_distinct(r).alias("r1"),
        F.array_distinct(_grams(p, 2)).alias("p2"),
        F.array_distinct(_grams(r, 2)).alias("r2"),
    )

    def overlap_f(n: int) -> Column:
        shared = F.size(F.array_intersect(f"p{n}", f"r{n}"))
        return f_score(shared, F.size(f"p{n}"), F.size(f"r{n}"))

    return grams.select(
        key, overlap_f(1).alias("rouge_1"), overlap_f(2).alias("rouge_2"), "rouge_l"
    )


def _clipped(tokens: DataFrame, key: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 with counted n-grams."""

    def marked(side: str, n: int) -> Column:
        return F.transform(
            _grams(F.col(side), n),
            lambda gram: F.struct(F.lit(n).alias("n"), gram.alias("gram"), F.lit(int(side == "p")).alias("in_p")),
        )

    every = F.concat(*[marked(side, n) for n in (1, 2) for side in ("p", "r")])
    rows = tokens.select(key, F.explode(every).alias("g")).select(key, "g.*")
    counts = rows.groupBy(key, "n", "gram").agg(
        F.sum("in_p").alias("cp"), F.sum(1 - F.col("in_p")).alias("cr")
    )
    sums = counts.groupBy(key, "n").agg(
        F.sum(F.least("cp", "cr")).alias("shared"),
        F.sum("cp").alias("np"),
        F.sum("cr").alias("nr"),
    )
    score = f_score(F.col("shared"), F.col("np"), F.col("nr"))

    def of(n: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("n") == n, score)), F.lit(0.0))

    return sums.groupBy(key).agg(of(1).alias("rouge_1"), of(2).alias("rouge_2"))


def corpus_mean(scores: DataFrame, *columns: str) -> DataFrame:
    """Mean of per-pair scores over all pairs, rounded to four digits."""
    return scores.agg(*[F.round(F.avg(c), DIGITS).alias(c) for c in columns])


def eval_loss(token_logprobs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Mean over pairs of the mean token loss: ``eval_loss, num_samples``.

    ``pos`` counts tokens from 0; tokens at ``pos < prompt_len`` belong to the
    prompt and carry no loss. ``logprob`` is that of the token at its own
    position, so no shift is applied here.
    """
    per_pair = (
        token_logprobs.where(F.col("pos") >= F.col("prompt_len"))
        .groupBy(key)
        .agg((-F.avg("logprob")).alias("loss"))
    )
    return per_pair.agg(
        F.round(F.avg("loss"), DIGITS).alias("eval_loss"), F.count("*").alias("num_samples")
    )
