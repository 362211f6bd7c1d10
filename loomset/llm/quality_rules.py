"""Quality rules: a threshold table compiled into one projection.

Every rule bounds a ratio of a text. The table is plain data; ``verdict`` turns
it into one Column, so Spark evaluates all rules in a single pass over the text
without user functions, shuffles or collected state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomset.functions.once import with_once
from loomset.llm.words import BLANK_RUN, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Function words of the languages in the corpus; a parameter of ``measure``.
STOP_WORDS = (
    "the of and to in a is that it on for was with as be by are at from this or an not he "
    "der die das und ist in zu den von mit sich auf für nicht ein eine dem des im "
    "de la le les et un une que en dans pour est qui sur pas au du par avec "
    "el los las y por se con su para es una lo como del"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= ratio <= high``; texts under ``min_words`` words are not tested."""

    ratio: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# What a text must satisfy. The first two are the base rules; the others judge ratios of texts that pass them.
BASE_RULES = (
    Rule("n_words", low=20),
    Rule("repeat_percent", high=30),
)
RULES = (
    Rule("mean_word_length", low=1.5, high=25.0),
    Rule("symbols_per_word", high=0.25),
    Rule("duplicate_line_share", high=0.5),
    Rule("bullet_line_share", high=0.9),
    Rule("echo_share", high=0.4),
    Rule("stop_word_share", low=0.01, min_words=40),
)


def measure(
    docs: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS),
    prefix: str = "",
) -> DataFrame:
    """Add the counts the rules use, over the whole text.

    ``n_words``; ``word_chars``, their code points; ``n_symbols``, characters
    out of ``#*$%&|<>``; ``n_lines``, lines with a word; ``n_dup_lines``, those
    equal to an earlier line; ``n_bullets``, lines that begin with a list mark;
    ``n_stop_words``; ``n_echoes``, words equal to the word before them;
    ``n_repeat_words``, words inside a window of ``window``
    words that occurs at least twice in the text, its first place included.

    NULL and blank texts measure 0 everywhere. Rows stay one to one, whatever
    their ids, and other columns pass through; ``prefix`` goes before the new
    names where the table already has such columns.
    """
    taken = set(docs.columns)
    free = iter(n for n in (f"_m{i}" for i in range(100)) if n not in taken)
    w, lines, sums, wins, places = (next(free) for _ in range(5))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = with_once(docs, w, words(F.col(text)))
    rows = with_once(rows, lines, F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = with_once(rows, sums, F.transform(F.col(w), lambda x: F.xxhash64(x)))

    def window_hash(first: Column, i: Column) -> Column:
        return F.xxhash64(first, *[F.get(F.col(sums), i + k) for k in range(1, window)])

    starts = F.greatest(F.size(w) - (window - 1), F.lit(0))
    rows = with_once(rows, wins, F.transform(F.slice(F.col(sums), F.lit(1), starts), window_hash))
    rows = with_once(rows, places, _repeated_places(F.col(wins)))
    covered = F.aggregate(
        F.transform(
            F.col(places),
            lambda x, i: F.least(F.lit(window), F.coalesce(F.get(F.col(places), i + 1) - x, F.lit(window))),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    stops = sorted(set(stop_words))
    is_stop = F.filter(F.col(w), lambda x: F.lower(x).isin(stops)) if stops else F.array()
    measures = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(whole, BLANK_RUN, "")),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_bullets": F.size(F.filter(F.col(lines), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•|]"))),
        "n_stop_words": F.size(is_stop),
        "n_echoes": F.size(F.filter(F.col(w), lambda x, i: F.get(F.col(w), i - 1) == x)),
        "n_repeat_words": covered,
    }
    kept = [c for c in docs.columns if c not in {prefix + n for n in measures}]
    return rows.select(*kept, *[v.cast("bigint").alias(prefix + n) for n, v in measures.items()])


def _repeated_places(hashes: Column) -> Column:
    """Sorted positions of the values that occur more than once in an array.

    Most texts repeat no window; for them one pass over a hash set decides.
    The others are sorted with their positions, so equal values are neighbours.
    """
    tagged = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def twins(s: Column) -> Column:
        same = F.filter(
            s,
            lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]),
        )
        return F.array_sort(F.transform(same, lambda e: e["i"]))

    found = F.transform(F.array(F.array_sort(tagged)), twins)
    none = F.array().cast("array<int>")
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(F.get(found, F.lit(0)))


def ratios(prefix: str = "") -> dict[str, Column]:
    """The ratios a rule may name, from the columns of ``measure``; NULL where the divisor is 0."""

    def col(name: str) -> Column:
        return F.col(prefix + name)

    def share(part: str, whole: str, times: float = 1.0) -> Column:
        return F.try_divide(col(part) * F.lit(times), col(whole))

    return {
        "n_words": col("n_words").cast("double"),
        "repeat_percent": share("n_repeat_words", "n_words", 100.0),
        "mean_word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "bullet_line_share": share("n_bullets", "n_lines"),
        "stop_word_share": share("n_stop_words", "n_words"),
        "echo_share": share("n_echoes", "n_words"),
    }


def verdict(rules: tuple[Rule, ...], prefix: str = "") -> Column:
    """True where every rule holds. A ratio without a divisor (NULL) breaks no rule."""
    known = ratios(prefix)
    holds = F.lit(True)
    for rule in rules:
        value = known[rule.ratio]
        ok = F.lit(True)
        if rule.low is not None:
            ok = ok & (value >= rule.low)
        if rule.high is not None:
            ok = ok & (value <= rule.high)
        if rule.min_words:
            ok = ok | (F.col(f"{prefix}n_words") < rule.min_words)
        holds = holds & F.coalesce(ok, F.lit(True))
    return holds


def judge(
    docs: DataFrame,
    text: str = "text",
    base: tuple[Rule, ...] = BASE_RULES,
    rules: tuple[Rule, ...] = RULES,
    prefix: str = "",
) -> DataFrame:
    """``measure`` plus ``base_failed`` (a base rule is broken) and ``kept`` (no rule is broken)."""
    rows = measure(docs, text, prefix=prefix)
    return rows.withColumns(
        {
            f"{prefix}base_failed": ~verdict(base, prefix),
            f"{prefix}kept": verdict(base, prefix) & verdict(rules, prefix),
        }
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes every rule, with their columns unchanged."""
    prefix = "_q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rows = judge(docs, text, prefix=prefix)
    flag = f"{prefix}pass"
    return with_once(rows, flag, F.col(f"{prefix}kept")).where(F.col(flag)).select(*docs.columns)
