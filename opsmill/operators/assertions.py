"""Assertions on tables: run queries, compare their first value, report."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.functions.text import shell_words

RESULT_SCHEMA = "seq int, name string, status string, duration bigint, message string, suite string"
VALUE_SCHEMA = "seq int, name string, expected string, actual string"
SUITE = "SQLValidation"
#: Assertions of one projection; far more subqueries in one take Catalyst very long to plan.
_BATCH = 50
#: What a query that fails can raise; several subqueries that fail at once give the second.
_FAILURES = (PySparkException, Py4JJavaError)


@dataclass(frozen=True)
class Assertion:
    """``query`` gives a column ``result`` whose first value should read ``expected``."""

    name: str
    query: str
    expected: str

    @property
    def skipped(self) -> bool:
        return self.name == "" or self.name.startswith("#")


def assertions_from(rows: DataFrame) -> list[Assertion]:
    """Assertions of a table ``(seq, name, query, expected)``; definitions, so few rows."""
    return [
        Assertion(r["name"], r["query"], r["expected"])
        for r in rows.orderBy("seq").toLocalIterator()
    ]


def fill_query(query: str, values: Mapping[str, str]) -> str:
    """Put ``values`` into the places marked ``{{NAME}}`` and drop a final semicolon."""
    for name, value in values.items():
        query = query.replace("{{" + name + "}}", value)
    return query.strip().rstrip(";")


_CALL = r"(?:COUNT|SUM|AVG|MIN|MAX)\s*\((?:[^()]|\([^()]*\))*\)"
#: One aggregate (that may be cast) over the rows of one table, with a condition or without.
_AGGREGATE = re.compile(
    rf"\s*SELECT\s+(?P<before>CAST\s*\(\s*)?(?P<call>{_CALL})(?P<after>\s+AS\s+[\w(), ]+\))?\s+AS\s+(?P<name>result)"
    r"\s+FROM\s+(?P<table>(?:\w+|`[^`]+`)(?:\.(?:\w+|`[^`]+`))*)(?:\s+WHERE\s+(?P<condition>.+?))?\s*",
    re.I | re.S,
)
#: What the aggregate and its condition must not hold.
_MORE = re.compile(r"\b(SELECT|JOIN|GROUP|ORDER|SORT|LIMIT|OFFSET|HAVING|UNION|INTERSECT|EXCEPT|MINUS|WINDOW|OVER)\b|--|/\*", re.I)


def filtered_aggregate(query: str) -> tuple[str, str] | None:
    """The table of a query that is one aggregate of one table, and the aggregate with its condition.

    ``SELECT sum(a) AS result FROM t WHERE p`` is ``sum(a) FILTER (WHERE p)`` of ``t``, so that checks
    of one table with different conditions can share a scan. None for any other query.
    """
    found = _AGGREGATE.fullmatch(query)
    if not found or bool(found["before"]) != bool(found["after"]):
        return None
    if _MORE.search(f"{found['call']} {found['condition'] or ''}"):
        return None
    condition = f" FILTER (WHERE {found['condition']})" if found["condition"] else ""
    return found["table"].lower(), f"{found['before'] or ''}{found['call']}{condition}{found['after'] or ''}"


def _first_value(spark: SparkSession, query: str) -> DataFrame:
    """The first row's ``result`` column (in any case) as text, at most one row."""
    df = spark.sql(query)
    names = [c for c in df.columns if c.lower() == "result"]
    value = F.col(f"`{names[0]}`") if names else F.lit(None)
    return df.select(value.cast("string").alias("actual")).limit(1)


def _row(seq: int, assertion: Assertion, actual: Column) -> Column:
    return F.struct(
        F.lit(seq).alias("seq"),
        F.lit(assertion.name).alias("name"),
        F.lit(assertion.expected).alias("expected"),
        actual.alias("actual"),
    )


@dataclass(frozen=True)
class _Ready:
    """An assertion whose query can be analysed: its value, and its table if it is one aggregate of it."""

    assertion: Assertion
    value: Column
    table: str | None


def _ready(spark: SparkSession, assertion: Assertion, values: Mapping[str, str]) -> _Ready:
    """Raises when the query cannot be analysed."""
    if assertion.skipped:
        return _Ready(assertion, F.lit(None).cast("string"), None)
    query = fill_query(assertion.query, values)
    found = filtered_aggregate(query)
    if found:
        query = f"SELECT {found[1]} AS result FROM {found[0]}"
    return _Ready(assertion, _first_value(spark, query).scalar(), found[0] if found else None)


def _by_table(runnable: dict[int, _Ready]) -> list[dict[int, _Ready]]:
    """The assertions that aggregate one table together, each other one by itself."""
    groups: dict[object, dict[int, _Ready]] = {}
    for seq, one in runnable.items():
        groups.setdefault(one.table or seq, {})[seq] = one
    return list(groups.values())


def _values_of(spark: SparkSession, runnable: dict[int, _Ready]) -> DataFrame:
    """``(seq, name, expected, actual)`` by scalar subqueries; Catalyst makes those on one table one scan."""
    rows = [_row(seq, one.assertion, one.value) for seq, one in runnable.items()]
    if not rows:
        return spark.createDataFrame([], VALUE_SCHEMA)
    parts = [spark.range(1).select(F.inline(F.array(*rows[i : i + _BATCH]))) for i in range(0, len(rows), _BATCH)]
    return reduce(DataFrame.unionByName, parts)


def assertion_values(
    spark: SparkSession, assertions: Iterable[Assertion], values: Mapping[str, str] | None = None
) -> DataFrame:
    """``(seq, name, expected, actual)`` of all assertions, computed by one query.

    Each assertion becomes a scalar subquery of one projection. Catalyst merges those that
    aggregate one table, with or without a condition (``filtered_aggregate``). A query without
    rows gives NULL.
    """
    return _values_of(spark, {seq: _ready(spark, a, values or {}) for seq, a in enumerate(assertions, 1)})


def judge(values: DataFrame, tolerance: float | None = None) -> DataFrame:
    """``status`` and ``message`` of ``(seq, name, expected, actual)`` rows.

    Values are compared as text after removing quotes and extra blanks; a
    missing value reads ``null``. With ``tolerance``, two numbers also agree
    when they differ by no more than that.
    """
    skipped = (F.col("name") == "") | F.col("name").startswith("#")
    expected = shell_words(F.col("expected"))
    actual = shell_words(F.coalesce("actual", F.lit("null")))
    agree = expected == actual
    if tolerance is not None:
        gap = F.abs(expected.try_cast("double") - actual.try_cast("double"))
        agree = agree | F.coalesce(gap <= tolerance, F.lit(False))
    title = F.when(F.col("name") == "", "Unnamed Skipped Test").otherwise(shell_words(F.col("name")))
    message = F.concat(
        F.lit("Expected '"), expected, F.lit("', got '"), actual, F.lit("'")
    )
    return values.select(
        "seq",
        F.when(skipped, title).otherwise(F.col("name")).alias("name"),
        F.when(skipped, "skipped").when(agree, "passed").otherwise("failed").alias("status"),
        F.when(skipped | agree, "").otherwise(message).alias("message"),
        F.lit(SUITE).alias("suite"),
    )


def _results(judged: DataFrame, milliseconds: int | None) -> list[tuple]:
    """Collected result rows; a skipped test takes no time."""
    found = judged.select("seq", "name", "status", "message", "suite").collect()
    return [
        (r["seq"], r["name"], r["status"], 0 if r["status"] == "skipped" else milliseconds, r["message"], r["suite"])
        for r in found
    ]


def _failure(seq: int, assertion: Assertion, error: Exception, milliseconds: int | None) -> tuple:
    reason = (error.getCondition() if isinstance(error, PySparkException) else None) or type(error).__name__
    return (seq, assertion.name, "failed", milliseconds, f"Query failed: {reason}", SUITE)


def _run_timed(spark: SparkSession, groups: list[dict[int, _Ready]], tolerance: float | None) -> list[tuple]:
    """One query per group, whose time its assertions share; if it fails, one per assertion."""
    results = []
    for group in groups:
        begun = time.monotonic()
        try:
            found = _results(judge(_values_of(spark, group), tolerance), None)
        except _FAILURES as error:
            if len(group) > 1:
                results += _run_timed(spark, [{seq: one} for seq, one in group.items()], tolerance)
                continue
            ((seq, one),) = group.items()
            found = [_failure(seq, one.assertion, error, None)]
        ran = max(1, sum(r[2] != "skipped" for r in found))
        taken = max(1, round((time.monotonic() - begun) * 1000 / ran))
        results += [(*r[:3], 0 if r[2] == "skipped" else taken, *r[4:]) for r in found]
    return results


def _run_together(spark: SparkSession, runnable: dict[int, _Ready], tolerance: float | None) -> list[tuple]:
    """All assertions by one query; if that fails, either half by its own, down to the one at fault."""
    try:
        return _results(judge(_values_of(spark, runnable), tolerance), None)
    except _FAILURES as error:
        entries = list(runnable.items())
        if len(entries) == 1:
            ((seq, one),) = entries
            return [_failure(seq, one.assertion, error, None)]
        middle = len(entries) // 2
        halves = (dict(entries[:middle]), dict(entries[middle:]))
        return [r for half in halves for r in _run_together(spark, half, tolerance)]


def run_assertions(
    spark: SparkSession,
    assertions: Iterable[Assertion],
    values: Mapping[str, str] | None = None,
    tolerance: float | None = None,
    timed: bool = True,
) -> DataFrame:
    """Run assertions now and return their results (``RESULT_SCHEMA``).

    With ``timed`` the assertions that aggregate one table are one query with one scan, and
    each other one is a query of its own; ``duration`` is what the query took, in equal
    shares. Otherwise all are one query, which reads tables fewer times but cannot tell
    single durations apart: they are NULL. Queries that cannot be analysed or fail to
    run are reported as failed and don't stop the others.
    """
    results: list[tuple] = []
    runnable: dict[int, _Ready] = {}
    for seq, one in enumerate(assertions, 1):
        begun = time.monotonic()
        try:
            runnable[seq] = _ready(spark, one, values or {})
        except _FAILURES as error:
            taken = max(1, round((time.monotonic() - begun) * 1000)) if timed else None
            results.append(_failure(seq, one, error, taken))
    if timed:
        results += _run_timed(spark, _by_table(runnable), tolerance)
    elif runnable:
        results += _run_together(spark, runnable, tolerance)
    return spark.createDataFrame(sorted(results, key=lambda r: r[0]), RESULT_SCHEMA)


def echo_assertions(spark: SparkSession, assertions: Iterable[Assertion]) -> DataFrame:
    """Results as if every query gave what is expected, headed by a made-up test.

    Checks the reporting without running a query. The made-up test's name
    depends on whether the minute is even.
    """
    even = datetime.now(timezone.utc).minute % 2 == 0
    title = "Fake Failing Test" if even else "Fake Passing Test"
    listed = [Assertion(title, "", "expected"), *assertions]
    rows = [(i, a.name, a.expected, a.expected) for i, a in enumerate(listed, 1)]
    return spark.createDataFrame(
        _results(judge(spark.createDataFrame(rows, VALUE_SCHEMA)), 1), RESULT_SCHEMA
    )


def table_checks(df: DataFrame, checks: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """``(seq, name, expected, actual)`` of aggregate checks on one table, in one pass.

    ``checks`` maps a name to an aggregate (``F.count_if(...)``, say) and the
    expected text.
    """
    totals = df.agg(*[agg.cast("string").alias(f"_{i}") for i, (agg, _) in enumerate(checks.values())])
    rows = [
        F.struct(
            F.lit(i + 1).alias("seq"),
            F.lit(name).alias("name"),
            F.lit(expected).alias("expected"),
            F.col(f"_{i}").alias("actual"),
        )
        for i, (name, (_, expected)) in enumerate(checks.items())
    ]
    return totals.select(F.inline(F.array(*rows)))
