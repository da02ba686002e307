"""Generated sensor readings and payments.

The ``add_*`` functions put generated columns on the rows of any DataFrame
that has an id; the ``generate_*`` functions start from ``spark.range``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.functions.draws import pick, uniform_int, uniform_real, uuid_text

# Lowest and highest reading of sensor_0 ... sensor_11.
READING_RANGES = [
    (0.0, 1.0), (20.0, 30.0), (100.0, 130.0), (25.0, 50.0), (90.0, 110.0), (15.0, 20.0),
    (90.0, 110.0), (10.0, 15.0), (2.0, 4.0), (2.0, 5.0), (0.5, 2.0), (0.0, 1.0),
]
# Sensor numbers, payment amounts and payment codes.
SENSOR_NUMBERS = (1, 101)
AMOUNTS = (10, 1000)
CURRENCIES = ["USD", "EUR", "GBP", "JPY"]
STATUSES = ["PENDING", "COMPLETED", "FAILED"]
METHODS = ["CREDIT_CARD", "PAYPAL", "BANK_TRANSFER"]
DAY_SECONDS = 86400


def add_readings(rows: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """``sensor_id`` and ``sensor_0`` ... ``sensor_11`` for each row."""
    key = F.col(row_id)
    sensors = [
        uniform_real(key, seed, f"sensor_{i}", low, high).alias(f"sensor_{i}")
        for i, (low, high) in enumerate(READING_RANGES)
    ]
    return rows.select(uniform_int(key, seed, "sensor_id", *SENSOR_NUMBERS).alias("sensor_id"), *sensors)


def add_payments(rows: DataFrame, row_id: str, as_of: Column, seed: int = 0) -> DataFrame:
    """A made-up payment for each row, within the day before ``as_of``.

    Currency, status and method are drawn from one slot more than there are
    codes, so some of them are NULL.
    """
    key = F.col(row_id)
    age = uniform_int(key, seed, "age", -DAY_SECONDS, 0)
    return rows.select(
        uuid_text(key, seed, "payment_id").alias("payment_id"),
        uuid_text(key, seed, "user_id").alias("user_id"),
        uniform_int(key, seed, "amount", *AMOUNTS).cast("decimal(10,2)").alias("amount"),
        pick(key, seed, "currency", CURRENCIES).alias("currency"),
        pick(key, seed, "status", STATUSES).alias("status"),
        pick(key, seed, "payment_method", METHODS).alias("payment_method"),
        (as_of + F.make_interval(secs=age)).alias("timestamp"),
    )


def generate_readings(spark: SparkSession, count: int = 5000, seed: int = 0) -> DataFrame:
    return add_readings(spark.range(count), "id", seed)


def generate_payments(
    spark: SparkSession, count: int = 100, as_of: Column | None = None, seed: int = 0
) -> DataFrame:
    as_of = F.current_timestamp() if as_of is None else as_of
    return add_payments(spark.range(count), "id", as_of, seed)
