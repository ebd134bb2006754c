"""Running sums and ranks over sorted rows that lie in many partitions: each is swept once, what it ends with is carried on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import written

_OWN = [("__part", "int"), ("__row", "long"), ("__open", "boolean"), ("__group", "long")]


def _swept(rows: DataFrame, same: list[str], order: list[str], sums: list[str], xors: list[str]) -> DataFrame:
    """The rows, sorted over all partitions and swept within each, as a written table.

    Of ``sums`` and ``xors`` each row has the running value since its group (rows with the same ``same``) began in the
    partition; __open says whether that was at the partition's start, __group numbers the partition's groups from 0.
    """
    names = rows.columns
    # rows with equal keys may be split as they come; the first columns of the order are mostly enough to tell rows apart
    data = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in _OWN)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, group, before = TaskContext.get().partitionId(), 0, 0, None
        carry = dict.fromkeys([*sums, *xors], np.int64(0))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(c).to_numpy() for c in same]
            new = np.zeros(n, bool)
            for k, key in enumerate(keys):
                new[1:] |= key[1:] != key[:-1]
                new[0] |= before is not None and key[0] != before[k]
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            columns = {c: batch.column(c) for c in names}
            for c in [*sums, *xors]:
                v = columns[c].to_numpy()
                add = c in sums
                upto = np.cumsum(v) if add else np.bitwise_xor.accumulate(v)
                base = np.where(start >= 0, (upto - v if add else upto ^ v)[np.maximum(start, 0)], -carry[c] if add else carry[c])
                out = upto - base if add else upto ^ base
                carry[c] = out[-1]
                columns[c] = pa.array(out)
            of = group + np.cumsum(new)
            own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(of == 0), pa.array(of)]
            before, row, group = [key[-1] for key in keys], row + n, int(of[-1])
            yield pa.RecordBatch.from_arrays([*columns.values(), *own], names=schema.names)

    return written(data.mapInArrow(run, schema))


def _parts(swept: DataFrame, same: list[str], values: list[str]) -> list:
    """First and last row of each partition, in order: as many rows as partitions."""
    what = F.struct(*same, *values, "__open", "__group")
    return swept.groupBy("__part").agg(F.min_by(what, "__row").alias("first"), F.max_by(what, "__row").alias("last")).orderBy("__part").collect()


def running(rows: DataFrame, same: list[str], order: list[str], sums: list[str] | None = None, xors: list[str] | None = None) -> DataFrame:
    """Replaces the columns ``sums`` and ``xors`` by their running values, the row's own included.

    Values restart where ``same`` changes; with no such column they run over all rows. The order is by ``order``,
    which ``same`` must begin; both hold no nulls where they are in ``same``. All these columns are longs. A group
    may span any number of partitions. An empty table gives no row.
    """
    sums, xors = sums or [], xors or []
    values = [*sums, *xors]
    swept = _swept(rows, same, order, sums, xors)
    carries, at, carry = [], None, {}
    for p in _parts(swept, same, values):
        key = tuple(p["first"][c] for c in same)
        carry = carry if at == key else dict.fromkeys(values, 0)
        carries.append((p["__part"], *carry.values()))
        last = p["last"]
        tail = {c: last[c] + carry[c] if c in sums else last[c] ^ carry[c] for c in values}
        carry = tail if last["__open"] else {c: last[c] for c in values}
        at = tuple(last[c] for c in same)
    if not carries:
        return rows.limit(0)
    # a row for each partition
    known = rows.sparkSession.createDataFrame(carries, ", ".join(["__part int", *(f"`__c_{c}` long" for c in values)]))
    joined = swept.join(F.broadcast(known), "__part")
    mended = {c: F.when(F.col("__open"), F.col(c) + F.col(f"__c_{c}") if c in sums else F.col(c).bitwiseXOR(F.col(f"__c_{c}"))).otherwise(F.col(c)) for c in values}
    return joined.withColumns(mended).select(*rows.columns)


def dense_ranks(rows: DataFrame, same: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the dense rank of each row's group, from 1, as ``name``: groups have the same ``same`` and are neighbours by ``order``."""
    swept = _swept(rows, same, order, [], [])
    carries, at, total = [], None, 0
    for p in _parts(swept, same, []):
        total -= at == tuple(p["first"][c] for c in same)  # its first group is the last one of the partition before
        carries.append((p["__part"], total + 1))
        total += p["last"]["__group"] + 1
        at = tuple(p["last"][c] for c in same)
    if not carries:
        return rows.withColumn(name, F.lit(0).cast("long")).limit(0)
    known = rows.sparkSession.createDataFrame(carries, "__part int, __from long")
    return swept.join(F.broadcast(known), "__part").select(*rows.columns, (F.col("__group") + F.col("__from")).alias(name))
