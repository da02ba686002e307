"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are dealt over partitions by range of the order, so that equal keys may be split,
and sorted. Each task sums the sizes of its rows as they pass. The totals, one row per
partition, give every partition its offset; a row's offset in its partition plus that is
its place in one long run of bytes, which is cut at equal targets. A row belongs where its
middle lies, so that a shard misses its target by at most one row's size.

The order of the query is by the hash of the text, then by identifier: equal texts stand
side by side, and only a cut can part them; a text that holds a third of all rows still is
many rows, and is spread over as many shards as its bytes need.

Defined cases: a null text has no bytes and counts 8 like any row; null identifiers come
first; repeated rows each have a place; an empty table gives an empty result; with fewer
bytes than shards some shards stay empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsmill.llm.common import batch_of, crc_text, small_batches, table, written

SHARDS = 24
#: Bytes that a row counts beside its text.
ROW_BYTES = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the bytes and rows of the partition that stand before each row."""
    part, held, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends = held + np.cumsum(size)
        schema = pa.schema([*batch.schema, ("part", pa.int32()), ("before", pa.int64()), ("nth", pa.int64())])
        yield batch_of(
            schema,
            [*batch.columns, np.full(len(size), part, "i4"), ends - size, np.arange(rows, rows + len(size))],
        )
        held, rows = int(ends[-1]) if len(ends) else held, rows + len(size)


def byte_shards(rows: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` (with a column size) with shard and slot, contiguous in the given order.

    ``rows`` must not have the columns part, before, nth, shard and slot.
    """
    spark = rows.sparkSession
    small_batches(spark, 4096)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, part int, before long, nth long"
    placed = written(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_running, schema), "placed"
    )
    # One row per partition from here on.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    total = totals.agg(F.sum("bytes")).first()[0] or 1
    middle = 2 * (F.col("bytes_before") + F.col("before")) + F.col("size")
    cut = placed.join(offsets, "part").select(
        *rows.columns,
        F.least(F.floor(middle * shards / F.lit(2 * total)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth")).alias("place"),
    )
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        *rows.columns, "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the hash that the order begins with."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        crc_text(F.col("text")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of nearly equal bytes."""
    rows = sized(table(spark, sf_dir, "documents"))
    return byte_shards(rows, ["text_hash", "doc_id", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
