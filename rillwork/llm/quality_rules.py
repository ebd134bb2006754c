"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.text_stats import counts

#: (rule, statistic, least, most): a text fails a rule whose statistic lies outside. None: no bound.
THRESHOLDS = [
    ("word_length", "mean_word_chars", 2.0, 12.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("capitals", "upper_word_ratio", None, 0.2),
    ("repetition", "repeat_word_ratio", None, 0.3),
    ("lines", "dup_line_ratio", None, 0.5),
    ("digits", "digit_ratio", None, 0.25),
    ("letters", "nonletter_ratio", None, 0.6),
    ("vocabulary", "distinct_word_ratio", 0.02, None),
    ("stop_words", "stop_word_ratio", 0.02, 0.6),  # for the four languages of STOP_WORDS; give other bounds for others
]


def ratios() -> dict[str, Column]:
    """The statistics that THRESHOLDS names, over the columns of text_stats.counts()."""
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_text"))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_word_ratio": F.col("n_upper_words") / words,
        "repeat_word_ratio": F.col("n_repeat_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "digit_ratio": F.col("n_digits") / chars,
        "nonletter_ratio": F.col("n_nonletters") / chars,
        "distinct_word_ratio": F.col("n_distinct_words") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
    }


def verdict(thresholds=None) -> Column:
    """The names of the rules that a text fails, as one array expression."""
    of = ratios()

    def fails(statistic, least, most):
        parts = [p for p in (least is not None and of[statistic] < least, most is not None and of[statistic] > most) if p is not False]
        return reduce(lambda a, b: a | b, parts)

    named = [F.when(fails(s, a, b), F.lit(rule)) for rule, s, a, b in thresholds or THRESHOLDS]
    return F.array_compact(F.array(*named))


def apply_rules(docs: DataFrame, thresholds=None) -> DataFrame:
    """Counts, base verdict, failed rules and the final verdict of every row.

    Null and empty texts have no words and fail the base rule (under 50 words); repeated rows stay, each with its
    verdict; an empty table gives no row; columns besides doc_id and text are ignored, whatever their names.
    """
    out = counts(docs, ["doc_id"])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumns({"base_failed": base, "failed_rules": verdict(thresholds)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
