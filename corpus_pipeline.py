"""A corpus pipeline of five stages over documents; each stage is written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from rillwork.llm.common import bucket_of, shared_dir, table, written

#: Of a document's probability for its language.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of no clear one, go. Learned as op1 learns.

    Null and empty texts, and texts without a letter, have no language and go. Each of repeated rows is judged
    alike; a very long text is judged whole; an empty table stays empty; other columns keep names and values,
    whatever they are called. Ties between languages go to the first by name.
    """
    names = docs.columns
    model = language_id.fit(language_id.collect_samples(docs.where(bucket_of("doc_id", 3) != 1).select("text", "lang")))
    rest = [c for c in names if c != "text"]
    data = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], "text")
    out = language_id.predict(data, model, [f"c{i}" for i in range(len(rest))], with_text=True)
    kept = out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    back = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {"text": F.col("__text")}
    return kept.select(*[back[c].alias(c) for c in names])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more stay in the document of the least doc_id that has them.

    No row goes. Null and empty texts become or stay empty; rows that share a doc_id are one document and lose no
    line to each other; rows without a doc_id keep all lines; an empty table stays empty. n_chars, if there, is
    counted anew; other columns keep names and values, whatever they are called.
    """
    names = docs.columns
    rest = [c for c in names if c not in ("text", "doc_id")]
    data = docs.select("doc_id", "text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    out = line_dedup.apply_bitmaps(data, line_dedup.keep_bitmaps(data), ["doc_id", *(f"c{i}" for i in range(len(rest)))])
    new = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in names:
        new["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) for c in names])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 or more, the one with the least doc_id stays.

    Null, empty and wordless texts are linked with nothing and stay, as do rows without a doc_id. Rows that share a
    doc_id are one document, which goes only if every text of it is linked to a lesser doc_id; so repeated rows stay
    or go together. doc_id is a whole number. An empty table stays empty; other columns are kept as they are.
    """
    found = ngram_join.link_components(docs.select("doc_id", "text"), ngram_join.JoinParams(shingle=5, percent=80))
    copies = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("copy")).where("copy").select("doc_id"))
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go.

    Null and empty texts and rows without a doc_id stay. Rows that share a doc_id are one document, which goes if
    one of its texts holds an item. An empty table stays empty; other columns are kept as they are.
    """
    leaks = written(decontaminate.find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time a document is drawn into the mixture: mixing.mix() states what it does with odd rows."""
    return mixing.mix(docs.select("doc_id", "text", "source"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL cannot express the first stage. Tests hold each stage's rows against a plain Python version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
