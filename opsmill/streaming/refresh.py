"""Maintained tables: parsed messages, hourly means, and the status join.

Each function starts a query and returns it. ``lag`` is the longest time a
table may be behind; None processes what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from opsmill.operators.payments import (
    ACK_COLUMNS,
    TRANSFER_COLUMNS,
    joined_columns,
    parse_acknowledgements,
    parse_transfers,
    status_pairs,
)
from opsmill.sources.files import as_messages
from opsmill.streaming.graph import BASE, Batch, Maintained, RefreshGraph
from opsmill.streaming.runs import ORDER, RunTable

MESSAGE_SCHEMA = "file_name string, load_ts timestamp, raw_xml string"
DEFAULT_LAG = "60 minutes"


def stream_table(
    spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """A Parquet folder as a stream of its rows."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_landing(spark: SparkSession, path: str) -> DataFrame:
    """XML files arriving in a folder as a stream of messages."""
    raw = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xml")
        .text(path, wholetext=True)
    )
    return as_messages(raw)


def _start(writer, lag: str | None) -> StreamingQuery:
    if lag is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=lag).start()


def maintain_transfers(
    messages: DataFrame, target: str, checkpoint: str, lag: str | None = DEFAULT_LAG
) -> StreamingQuery:
    """Keep the parsed credit transfers up to date; no state is needed."""
    writer = parse_transfers(messages).writeStream.format("parquet").option("path", target)
    return _start(writer.option("checkpointLocation", checkpoint), lag)


def maintain_acknowledgements(
    messages: DataFrame, target: str, checkpoint: str, lag: str | None = DEFAULT_LAG
) -> StreamingQuery:
    """Keep the parsed status reports up to date; no state is needed."""
    writer = parse_acknowledgements(messages).writeStream.format("parquet").option("path", target)
    return _start(writer.option("checkpointLocation", checkpoint), lag)


def maintain_hourly(
    readings: DataFrame,
    target: str,
    checkpoint: str,
    lag: str | None = DEFAULT_LAG,
    lateness: str | None = None,
) -> StreamingQuery:
    """Keep hourly means up to date; read them with ``current_hourly``.

    Each batch writes the hours it changed, as a run of the target; runs are merged so that what
    is stored and read goes by the number of hours, not of batches. Without ``lateness`` any
    reading still counts, and the state keeps one row per sensor and hour; with it,
    hours older than that are closed and leave the state.
    """
    if lateness is not None:
        readings = readings.withWatermark("reading_ts", lateness)
    hours = readings.groupBy("sensor_id", F.window("reading_ts", "1 hour")).agg(
        F.avg("reading_value").alias("avg_value"), F.count("*").alias("cnt")
    ).select("sensor_id", F.col("window.start").alias("hour_ts"), "avg_value", "cnt")

    table = hourly_table(readings.sparkSession, target)
    writer = hours.writeStream.outputMode("update").foreachBatch(table.commit)
    return _start(writer.option("checkpointLocation", checkpoint), lag)


def _latest_hours(rows: DataFrame) -> DataFrame:
    """Of the runs' values of a sensor and hour, the newest."""
    latest = F.max_by(F.struct("avg_value", "cnt"), ORDER).alias("_now")
    return rows.groupBy("sensor_id", "hour_ts").agg(latest).select("sensor_id", "hour_ts", "_now.avg_value", "_now.cnt")


def hourly_table(spark: SparkSession, target: str) -> RunTable:
    return RunTable(spark, target, merged=_latest_hours)


def current_hourly(spark: SparkSession, target: str) -> DataFrame:
    """The latest value of each sensor and hour."""
    return hourly_table(spark, target).read()


#: Folders into which the rows of a maintained payment table are dealt, by their message.
BUCKETS = 64


def _in_buckets(rows: DataFrame, message: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(message), F.lit(BUCKETS)).cast("int"))


def _added_status(batch: Batch) -> DataFrame:
    """The transfers of a batch, and the pairs that it completes.

    New transfers meet all acknowledgements, new acknowledgements the older transfers, however old.
    Of the older rows only the folders are read in which the new ones can have partners.
    """

    def older(name: str, other: str) -> DataFrame:
        return batch.before(name).where(F.col("bucket").isin([int(b) for b in batch.folders(other) if b.isdigit()]))

    transfers, acks = batch.new("transfers"), batch.new("acks")
    pairs = status_pairs(transfers, older("acks", "transfers").unionByName(acks)).unionByName(
        status_pairs(older("transfers", "acks"), acks)
    )
    silent = transfers.alias("p").select(F.col("p.transaction_id").alias("transaction_id"), *joined_columns(False))
    return pairs.withColumn("part", F.lit("pair")).unionByName(silent.withColumn("part", F.lit("transfer")))


def payment_tables(
    transfers: Callable[[DataFrame], DataFrame] = parse_transfers,
    acks: Callable[[DataFrame], DataFrame] = parse_acknowledgements,
    lag: float | None = 3600,
    **joined: object,
) -> list[Maintained]:
    """The two tables of parsed messages and the status join built on them.

    The functions take the rows of the base. The join decides how fresh the other two must be.
    """
    return [
        Maintained("joined", ("transfers", "acks"), _added_status, lag, ("part",), **joined),
        Maintained("transfers", (BASE,), lambda b: _in_buckets(transfers(b.base), "message_id"), None, ("bucket",)),
        Maintained("acks", (BASE,), lambda b: _in_buckets(acks(b.base), "original_message_id"), None, ("bucket",)),
    ]


def maintain_status_join(
    transfers: DataFrame,
    acks: DataFrame,
    target: str,
    checkpoint: str,
    lag: str | None = DEFAULT_LAG,
) -> StreamingQuery:
    """Keep the join of two streams of parsed rows up to date, with no time bound.

    Nothing is in the state store: the rows of both sides are tables of runs below the target,
    dealt into folders by their message, and a batch looks its new rows up in them. They have the
    columns that the join reads; a batch is read as it is, so others would be read, dealt and written as well.
    Nothing that is written changes later: a batch appends its
    transfers and its new pairs, and ``current_status_join`` finds the transfers that
    have no pair. A version makes a batch visible as a whole or not at all, and a
    replayed batch counts once.
    """
    both = transfers.select(F.struct(*TRANSFER_COLUMNS).alias("p")).unionByName(
        acks.select(F.struct(*ACK_COLUMNS).alias("a")), allowMissingColumns=True
    )
    tables = payment_tables(
        lambda base: base.where("p IS NOT NULL").select("p.*"),
        lambda base: base.where("a IS NOT NULL").select("a.*"),
        folder=target, merge_below=0,
    )
    graph = RefreshGraph(transfers.sparkSession, f"{target}/_inputs", tables)
    return _start(both.writeStream.foreachBatch(graph.refresh).option("checkpointLocation", checkpoint), lag)


def current_status_join(spark: SparkSession, target: str) -> DataFrame:
    """The pairs, and the transfers whose ids are in no pair."""
    return latest_status(RunTable(spark, target).read())


def latest_status(rows: DataFrame) -> DataFrame:
    """The pairs, and the transfers whose ids are in no pair, of a maintained status join."""
    ids = ["pacs008_message_id", "pacs008_end_to_end_id", "transaction_id"]
    # A struct is never NULL itself, so that missing ids compare equal.
    rows = rows.withColumn("_ids", F.struct(*ids))
    pairs = rows.where("part = 'pair'")
    silent = rows.where("part = 'transfer'").join(pairs.select("_ids").distinct(), "_ids", "left_anti")
    return pairs.unionByName(silent).drop("_ids", "part", "transaction_id")
