"""Sensor readings: location join, hourly means, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_places(readings: DataFrame, places: DataFrame) -> DataFrame:
    """Readings with the place of their sensor; readings of unknown sensors drop out.

    No broadcast is forced: Spark broadcasts ``places`` when its measured size
    is below ``spark.sql.autoBroadcastJoinThreshold``. Otherwise both sides are
    shuffled on ``sensor_id`` and AQE splits the partitions of busy sensors.
    """
    places = places.select(F.col("sensor_id").cast("bigint"), "city", "latitude", "longitude")
    return readings.withColumn("sensor_id", F.col("sensor_id").cast("bigint")).join(
        places, "sensor_id"
    ).select("sensor_id", "sensor_0", "city", "latitude", "longitude")


def hourly_means(readings: DataFrame) -> DataFrame:
    """Mean and number of readings per sensor and hour.

    Partial aggregation runs before the shuffle, so a sensor with very many
    rows sends one row per hour and task.
    """
    return readings.groupBy(
        "sensor_id", F.date_trunc("hour", "reading_ts").alias("hour_ts")
    ).agg(F.avg("reading_value").alias("avg_value"), F.count("*").alias("cnt"))


def recent_readings(readings: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Readings of the day before ``as_of`` (now by default) and later ones."""
    as_of = F.current_timestamp() if as_of is None else as_of
    return readings.where(F.col("reading_ts") >= as_of - F.expr("INTERVAL 1 DAY")).select(
        "sensor_id", "reading_value", "reading_ts"
    )
