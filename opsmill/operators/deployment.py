"""Summaries of deployment plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmill.sources.files import PLAN_SCHEMA


def parse_plan(document: Column) -> Column:
    """A plan document's text as a struct."""
    return F.from_json(document, PLAN_SCHEMA)


def summarise_plans(plans: DataFrame, plan: str = "plan") -> DataFrame:
    """Operation counts and dropped objects of each plan.

    A plan is one row, so its operations are counted inside the row: no
    explode and no shuffle.
    """
    operations = F.coalesce(
        F.col(f"{plan}.operations"), F.array().cast("array<struct<operation:string,object_name:string>>")
    )

    def of_kind(kind: str) -> Column:
        return F.filter(operations, lambda op: op["operation"] == kind)

    status = F.coalesce(F.col(f"{plan}.status"), F.lit("UNKNOWN"))
    others = [c for c in plans.columns if c != plan]
    return plans.select(
        *others,
        status.alias("status"),
        F.size(of_kind("CREATE")).alias("creates"),
        F.size(of_kind("ALTER")).alias("alters"),
        F.size(of_kind("DROP")).alias("drops"),
        F.size(of_kind("NO_OPERATION")).alias("unchanged"),
        F.transform(
            of_kind("DROP"), lambda op: F.coalesce(op["object_name"], F.lit("unknown"))
        ).alias("dropped_objects"),
        (status == "PLAN_FAILED").alias("failed"),
    )
