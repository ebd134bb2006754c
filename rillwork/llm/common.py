"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and are stripped from lines: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: Text that a Python task handles at once, in characters.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    One of our own only where none is set and all tasks run in this process; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="rillwork-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the labelled data."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def sampled_texts(docs: DataFrame, labels: DataFrame, shares: dict[int, float], most: int, seed: int) -> DataFrame:
    """(text, label) of the documents that stand in ``labels`` (doc_id, label): of each label such a share, by hash of the id.

    Only the chosen ids, ``most`` at most, are sent to the tasks; no text is shuffled for them.
    """
    parts = 1_000_000
    share = F.lit(0)
    for label, x in shares.items():
        share = F.when(F.col("label") == label, min(parts, 1 + int(parts * x))).otherwise(share)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)) < share).select("doc_id", "label").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def chunks(columns: list[list], size: int = CHUNK_CHARS, text: int = 1) -> Iterator[list[list]]:
    """Runs of the rows with about so many characters of text; one very long text is a run of its own."""
    start = chars = 0
    for i, t in enumerate(columns[text]):
        n = len(t) if t else 0
        if chars and chars + n > size:
            yield [c[start:i] for c in columns]
            start, chars = i, 0
        chars += n
    if start < len(columns[text]):
        yield [c[start:] for c in columns]


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, as UTF-8: bytes methods know exactly these characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
