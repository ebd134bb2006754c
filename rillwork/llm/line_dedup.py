"""Line deduplication: hashes range-partitioned and sorted, first occurrences found in one stream, bitmaps returned."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import written

LEAST_CHARS = 10
_LINES = "h1 long, h2 long, doc_id long, pos int, n_lines int"
_FOUND = "kind int, h1 long, h2 long, doc_id long, pos int, n_lines int"
DROP, OPEN, HEAD = 0, 1, 2


def _hashed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, ids, at, size = [], [], [], [], []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32())], names=["h1", "h2", "doc_id", "pos", "n_lines"])

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                for pos, line in enumerate(lines):
                    key = line.strip().lower()  # of bytes: [\x20\x09-\x0D] and A-Z only
                    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least:
                        continue
                    h = xxhash.xxh3_128_intdigest(key)
                    h1.append((h >> 64) - 2**63)
                    h2.append((h & (2**64 - 1)) - 2**63)
                    ids.append(doc_id)
                    at.append(pos)
                    size.append(len(lines))
                if len(h1) > 50_000:
                    yield out()
                    h1, h2, ids, at, size = [], [], [], [], []
            yield out()

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h1, h2, doc_id, pos). The first row of a hash names the document that keeps it.

    The first hash of a partition may have begun in an earlier one: its rows stay open. The first and last hash of
    each partition come out as heads, from which open rows are settled.
    """
    carry: tuple[int, int, int] | None = None  # the hash at hand and its first document here
    first = None  # the partition's first hash
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.empty(n, bool)
        new[0] = carry is None or (h1[0], h2[0]) != carry[:2]
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.cumsum(new) - 1  # -1: the carried run
        begins = ids[new]
        head = np.where(run >= 0, begins[np.maximum(run, 0)] if len(begins) else 0, carry[2] if carry else 0)
        heads = []
        if first is None:
            first = (int(h1[0]), int(h2[0]))
            heads.append((*first, int(ids[0])))
        opened = (h1 == first[0]) & (h2 == first[1])
        drop = (ids != head) & ~opened
        keep = np.flatnonzero(drop | opened)
        carry = (int(h1[-1]), int(h2[-1]), int(head[-1]))
        kind = np.where(opened[keep], OPEN, DROP).astype(np.int32)
        out = pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(batch.column(i).to_numpy(zero_copy_only=False)[keep]) for i in range(5))], names=["kind", "h1", "h2", "doc_id", "pos", "n_lines"])
        yield out
        if heads:
            yield _heads(heads)
    if carry:
        yield _heads([carry])


def _heads(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    zero = pa.array([0] * len(a), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([HEAD] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), zero, zero], names=["kind", "h1", "h2", "doc_id", "pos", "n_lines"])


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep_bitmap) of each document that loses a line; all others keep every line.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z in lower case. A key of ``least_chars`` code
    points or more stays only in the smallest doc_id that holds it, with all its lines there. keep_bitmap is a
    zlib-compressed little-endian bit string, one bit per line.

    Null and empty texts are one empty line, which is never dropped. Rows without a doc_id neither drop nor lose
    lines. Rows that share a doc_id are one document, so exact repetitions keep their lines alike. Other columns are
    ignored; an empty table gives no row. The sort key includes doc_id and position, so a line that a third of all
    documents hold is spread over as many partitions as its rows need.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(_hashed(least_chars), _LINES)
    rows = written(rows)  # the range partitioner looks at its input twice; hashes are far smaller than texts
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["h1", "h2", "doc_id", "pos"]
    found = written(rows.repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(_firsts, _FOUND))
    # at most two heads a partition: small at any size of the input
    heads = found.where(F.col("kind") == HEAD).groupBy("h1", "h2").agg(F.min("doc_id").alias("head"))
    settled = found.where(F.col("kind") == OPEN).join(F.broadcast(heads), ["h1", "h2"]).where("doc_id != head")
    drops = found.where(F.col("kind") == DROP).select("doc_id", "pos", "n_lines").union(settled.select("doc_id", "pos", "n_lines"))
    per_doc = drops.groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))

    @F.pandas_udf("binary")
    def bitmap(n_lines, dropped):
        def one(size, at):
            keep = np.ones(size, np.uint8)
            keep[np.asarray(at, np.int64)] = 0
            return zlib.compress(np.packbits(keep, bitorder="little").tobytes())

        import pandas as pd

        return pd.Series([one(a, b) for a, b in zip(n_lines, dropped, strict=True)], dtype=object)

    return per_doc.select("doc_id", F.col("n_lines").cast("long"), F.size("dropped").cast("long").alias("n_dropped"), bitmap("n_lines", "dropped").alias("keep_bitmap"))


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with n_lines, n_dropped and kept_text, the lines that stay joined by \\n."""
    bits = bitmaps.select("doc_id", F.col("keep_bitmap").alias("__bits"), F.col("n_lines").alias("__n"), F.col("n_dropped").alias("__gone"))
    joined = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text")).join(bits, "doc_id", "left")

    @F.pandas_udf("string")
    def kept(text, bits, size):
        import pandas as pd

        def one(t, b, n):
            if b is None:
                return t
            lines = t.split("\n")
            stay = np.ones(len(lines), bool)
            flags = unpack(b, int(n))[: len(lines)]
            stay[: len(flags)] = flags
            return "\n".join(line for line, k in zip(lines, stay, strict=True) if k)

        return pd.Series([one(*x) for x in zip(text, bits, size, strict=True)], dtype=object)

    return joined.select(
        *keep,
        F.size(F.split("__text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("__gone", F.lit(0)).cast("long").alias("n_dropped"),
        kept("__text", "__bits", "__n").alias("kept_text"),
    )
