"""Test history over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmill.functions.ordered import carry_forward


def track_tests(results: DataFrame, block: Column | None = None) -> DataFrame:
    """Each result with the test's previous one and its pass rate so far.

    ``results`` has ``(test, run_ts, run_id, status, duration)``; runs are
    ordered by time and id. History is carried from hour to hour (see
    ``carry_forward``), so a test with very many runs is spread over tasks.
    """
    block = F.date_trunc("hour", "run_ts") if block is None else block
    carried = carry_forward(
        results,
        keys=["test"],
        order=["run_ts", "run_id"],
        block=block,
        previous={"previous_status": "status", "previous_duration": "duration"},
        running={
            "runs": F.lit(1),
            "passed_runs": (F.col("status") == "passed").cast("bigint"),
            "failed_runs": (F.col("status") == "failed").cast("bigint"),
        },
    )
    status, before = F.col("status"), F.col("previous_status")
    change = (
        F.when(before.isNull(), "new")
        .when((status == "failed") & (before != "failed"), "newly_failing")
        .when((status != "failed") & (before == "failed"), "fixed")
        .otherwise("same")
    )
    return carried.select(
        "test", "run_ts", "run_id", "status", "duration", "previous_status",
        change.alias("change"),
        (F.col("duration") - F.col("previous_duration")).alias("duration_change"),
        "runs", "passed_runs", "failed_runs",
        (F.col("passed_runs") / F.col("runs")).alias("pass_rate"),
    )


def status_flips(history: DataFrame) -> DataFrame:
    """Results that differ from the test's previous one by failing or passing again."""
    return history.where(F.col("change").isin("newly_failing", "fixed"))


def run_totals(results: DataFrame, run: Column) -> DataFrame:
    """Counters and total duration per run."""
    status = F.col("status")
    return results.groupBy(run.alias("run")).agg(
        F.count("*").alias("tests"),
        *[F.count_if(status == s).alias(s) for s in ("passed", "failed", "skipped")],
        F.sum("duration").alias("duration"),
    )


def results_of_reports(reports: DataFrame, run_ts: Column, run_id: Column) -> DataFrame:
    """Past report documents (see ``read_reports``) as result rows."""
    return reports.select(
        run_ts.alias("run_ts"), run_id.alias("run_id"), F.explode("results.tests").alias("t")
    ).select(F.col("t.name").alias("test"), "run_ts", "run_id", "t.status", "t.duration")
