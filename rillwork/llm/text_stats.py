"""Statistics of a text as Spark columns: what the quality rules and the quality classifier look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = r"[\x20\x09-\x0D]"
#: Frequent words of four languages.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "der", "die", "und", "das", "den", "mit", "le", "la", "les", "de", "et", "des", "el", "los", "que", "en", "un", "une", "y"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable is."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more. Windows are sorted by hash; equal neighbours repeat."""

    def of(w):
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("p")))

        def covered(s):
            n = F.size(s)
            twice = F.filter(s, lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(s, i + 1)["h"])))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.sort_array(windows), covered))

    return let(words, of)


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and one struct ``s`` of counts over the whole text; a null text has no words.

    All in one projection of built-in functions: no shuffle, no user function.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w):
        size = lambda f: F.size(F.filter(w, f)).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            size(lambda x: (F.char_length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)).alias("n_upper_words"),
            size(lambda x: F.lower(x).isin(STOP_WORDS)).alias("n_stop_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        )

    words = F.filter(F.split(text, _WS + "+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    gone = lambda pattern: (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")
    return docs.select(
        *keep,
        let(words, of_words).alias("w"),
        of_lines.alias("l"),
        gone(r"[#*$%&|<>]+").alias("n_symbols"),
        gone(r"[0-9]+").alias("n_digits"),
        gone(r"[^\p{L}]+").alias("n_nonletters"),
        F.char_length(text).cast("long").alias("n_text"),
    ).select(*keep, "w.*", "l.*", "n_symbols", "n_digits", "n_nonletters", "n_text")
