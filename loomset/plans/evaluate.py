"""The score report of a set of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomset.operators.bertscore import bertscore
from loomset.operators.ordering import test_set
from loomset.operators.textscore import corpus_mean, eval_loss, pair_up, rouge, scoreable


def evaluate_held_out(
    examples: DataFrame, predictions: DataFrame, key: str = "order_key", **parts
) -> DataFrame:
    """The report of the held-out examples that can be scored.

    ``examples`` are split rows with ``pair_id``, ``prompt``, ``response`` and a
    unique ``key``; ``predictions`` has ``pair_id, prediction``. Held out are
    the validation rows or, without any, the last tenth (``test_set``). A row
    without a prediction is not scored. ``parts`` are those of ``evaluate``.
    """
    held = scoreable(test_set(examples, key).select("pair_id", "prompt", "response"))
    pairs = pair_up(predictions, held.select("pair_id", "prompt", "reference"))
    return evaluate(pairs, **parts)


def evaluate(
    pairs: DataFrame,
    token_vectors: DataFrame | None = None,
    token_logprobs: DataFrame | None = None,
    tokenizer: str = "whitespace",
    distinct_ngrams: bool = True,
) -> DataFrame:
    """One row: sample count, ROUGE, and matching score and loss if their inputs are given.

    Pairs that carry a prompt count only if prompt and reference are not empty.
    All parts are averaged over the same pairs: vectors and log-probabilities
    of other pairs are left out.
    """
    if "prompt" in pairs.columns or "instruction" in pairs.columns:
        pairs = scoreable(pairs)
    counted = pairs.select("pair_id")
    parts = [
        pairs.agg(F.count("*").alias("num_samples")),
        corpus_mean(
            rouge(pairs, tokenizer, distinct_ngrams), "rouge_1", "rouge_2", "rouge_l"
        ),
    ]
    if token_vectors is not None:
        parts.append(
            corpus_mean(
                bertscore(token_vectors.join(counted, "pair_id", "left_semi")),
                "bertscore_precision",
                "bertscore_recall",
                "bertscore_f1",
            )
        )
    if token_logprobs is not None:
        scored = token_logprobs.join(counted, "pair_id", "left_semi")
        parts.append(eval_loss(scored).select("eval_loss"))
    # Each part is one row with columns of its own: stacked, the maximum finds the value.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
