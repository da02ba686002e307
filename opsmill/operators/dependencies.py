"""Classification of object dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmill.functions.text import domain_prefix


def _flag(name: str, condition: Column) -> Column:
    """``name_true`` or ``name_false``; an unknown condition counts as false."""
    return F.when(condition, F.lit(f"{name}_true")).otherwise(F.lit(f"{name}_false")).alias(name)


def classify_dependencies(edges: DataFrame, base_database: str | None = None) -> DataFrame:
    """Edges seen from the object depended on, with four crossing flags.

    One pass, no shuffle; the filter on the base database reaches the scan.
    """
    if base_database is not None:
        edges = edges.where(F.col("referenced_database") == base_database)
    other_db = F.col("referenced_database") != F.col("referencing_database")
    base, user = F.col("referenced_schema"), F.col("referencing_schema")
    from_reference = base.like("REF_%")
    return edges.select(
        F.col("referenced_database").alias("base_database"),
        base.alias("base_schema"),
        F.col("referenced_object_name").alias("base_object"),
        F.col("referenced_object_id").alias("base_object_id"),
        F.col("referencing_database").alias("referenced_database"),
        user.alias("referenced_schema"),
        F.col("referencing_object_name").alias("referenced_object"),
        F.col("referencing_object_domain").alias("referenced_object_type"),
        F.col("referencing_object_id").alias("referenced_object_id"),
        _flag("cross_db", other_db),
        _flag("cross_schema", (base != user) & (domain_prefix(base) != domain_prefix(user))),
        _flag("cross_db_ref", other_db & from_reference),
        _flag("cross_schema_ref", (base != user) & from_reference),
    )


def summarise_dependencies(classified: DataFrame) -> DataFrame:
    """Edges and crossing edges per base schema."""
    flags = ["cross_db", "cross_schema", "cross_db_ref", "cross_schema_ref"]
    return classified.groupBy("base_database", "base_schema").agg(
        F.count("*").alias("edges"),
        *[F.count_if(F.col(flag) == f"{flag}_true").alias(flag) for flag in flags],
    )


def dependency_lines(classified: DataFrame) -> DataFrame:
    """The classified edges as comma-joined text lines ``(file, text)``, to be scanned like scripts."""
    return classified.select(
        F.concat_ws("/", "base_database", "base_schema").alias("file"),
        F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in classified.columns]).alias("text"),
    )
