"""Catalogue listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LISTING_SCHEMA = "schema_name string, object_name string, object_type string"


def list_schemas(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Schemas whose name fits ``pattern`` (``*`` and ``|`` as in SHOW DATABASES)."""
    rows = [(db.name,) for db in spark.catalog.listDatabases(pattern)]
    return spark.createDataFrame(rows, "schema_name string")


def list_objects(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Tables and views of the schemas that fit ``pattern``.

    Catalogue entries are metadata the driver already holds; no data is read.
    """
    rows = [
        (db.name, table.name, "VIEW" if table.tableType == "VIEW" else "TABLE")
        for db in spark.catalog.listDatabases(pattern)
        for table in spark.catalog.listTables(db.name)
        if not table.isTemporary
    ]
    return spark.createDataFrame(rows, LISTING_SCHEMA)


def count_objects(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Number of tables and views per schema, zero included."""
    from pyspark.sql import functions as F

    kind = F.col("object_type")
    return (
        list_schemas(spark, pattern)
        .join(list_objects(spark, pattern), "schema_name", "left")
        .groupBy("schema_name")
        .agg(
            F.count_if(kind == "TABLE").alias("tables"),
            F.count_if(kind == "VIEW").alias("views"),
        )
    )
