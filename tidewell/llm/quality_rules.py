"""Quality rules: a table of thresholds compiled into one Spark projection. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import SPACED_WORD, fresh_names, replace_columns

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "ce", "dans", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "con", "de", "del", "el", "las", "los", "no", "para", "por", "se", "su", "y",
    "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
)
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A measure of the text must lie in [low, high]; None leaves that side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Verdict on texts that pass the base rules.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("stop_word_share", 0.01, None),
    Rule("dup_line_share", None, 0.5),
    Rule("repeat_word_share", None, 0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column, window: int = 3) -> Column:
    """Number of words that lie in any window of that many words found twice or more in the array.

    Windows are compared by a 64-bit hash; sorting them puts equal ones side by side.
    """

    def count(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: F.get(ordered, i - 1)["h"].eqNullSafe(x["h"]) | F.get(ordered, i + 1)["h"].eqNullSafe(x["h"]))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + window - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + window).alias("end"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def windows(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.size(w) - (window - 1))
        hashed = F.transform(heads, lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, window)]).alias("h"), i.alias("i")))
        return _let(F.sort_array(hashed), count)

    return F.when(F.size(words) >= window + 1, _let(words, windows)).otherwise(F.lit(0))


def measure(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stop_words (bigint).

    A null text counts as empty: 0 throughout. Input columns of the added names are replaced, others, whatever their
    names, pass through.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    added = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    own = [F.col(f"`{c}`") for c in replace_columns(docs, *added).columns]
    words_name, lines_name = fresh_names(docs, "words", "lines")
    split = docs.select(*own, F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)).alias(words_name), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines_name))
    words, lines = F.col(words_name), F.col(lines_name)
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_window_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*stop_words))),
    }
    return split.select(*own, *[c.cast("bigint").alias(n) for n, c in counts.items()])


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: all rules hold."""
    ratios = _ratios()
    holds = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            holds = holds & (ratios[rule.measure] >= rule.low)
        if rule.high is not None:
            holds = holds & (ratios[rule.measure] <= rule.high)
    return holds


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds the counts of measure(), base_failed and kept (boolean); nothing is shuffled.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept:
    not base_failed and all rules hold. stop_words are those of four languages: texts in another one fail
    stop_word_share unless its words are given. A null text counts as empty: 0 throughout, base_failed. Input columns
    of the added names are replaced; other columns, whatever their names, pass through. Equal texts, so repeated
    rows, are judged alike; no documents, no rows.
    """
    measured = measure(replace_columns(docs, "base_failed", "kept"), stop_words)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({"base_failed": failed, "kept": ~failed & compiled(rules)})
