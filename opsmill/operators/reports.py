"""Test and lint reports: conversion, counting, and documents of any length."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill import places
from opsmill.functions.rows import with_once
from opsmill.functions.times import report_millis
from opsmill.functions.xml import drop_prolog, root_name, strip_outer_element
from opsmill.sources.files import REPORT_SCHEMA, REPORT_TEST

_OUTCOME = "array<struct<_message:string,_VALUE:string>>"
_CASE = f"struct<_name:string,_time:string,failure:{_OUTCOME},skipped:{_OUTCOME}>"
_SUITE = f"struct<_name:string,_time:string,testcase:array<{_CASE}>>"
_SUITES = f"testsuite array<{_SUITE}>, _malformed string"

# Fixed values of the report format.
REPORT_FORMAT = "CTRF"
SPEC_VERSION = "0.0.1"
DEFAULT_SUITE = "SQLValidation"
DEFAULT_CASE = "Unnamed"
# The lines around the issues of a document.
ISSUES_HEAD = '{"issues":['
ISSUES_FOOT = "]}"


def _case_test(case: Column, suite: Column) -> Column:
    """One test case as a report test; a failure outranks a skip."""
    failures = F.coalesce(F.size(case["failure"]), F.lit(0))
    failed = case["failure"].isNotNull() & (failures > 0)
    skipped = case["skipped"].isNotNull() & (F.size(case["skipped"]) > 0)
    failure, skip = F.get(case["failure"], F.lit(0)), F.get(case["skipped"], F.lit(0))
    seconds = F.coalesce(case["_time"], F.lit("0")).try_cast("double")
    return F.struct(
        F.coalesce(case["_name"], F.lit(DEFAULT_CASE)).alias("name"),
        F.when(failed, "failed").when(skipped, "skipped").otherwise("passed").alias("status"),
        report_millis(seconds).alias("duration"),
        F.when(failed, F.coalesce(failure["_message"], failure["_VALUE"], F.lit("")))
        .when(skipped, F.coalesce(skip["_message"], F.lit("")))
        .otherwise("")
        .alias("message"),
        suite.alias("suite"),
    )


def convert_junit(files: DataFrame) -> DataFrame:
    """JUnit files ``(path, xml)`` with their tests: ``(path, converted, stop, project, tests)``.

    A file is one row and stays one: suites and cases are walked inside the
    row. Files that are malformed, have another root, no suite, or a time that
    is no number are not converted and keep NULLs. ``stop`` is the time of the
    root's first child, ``project`` the name of its last; a child that is no suite has neither.
    """
    xml = F.col("xml")
    root = root_name(xml)
    body = F.when(root == "testsuite", drop_prolog(xml)).when(
        root == "testsuites", strip_outer_element(xml)
    )
    wrapped = F.concat(F.lit("<suites>"), body, F.lit("</suites>"))
    document = F.from_xml(wrapped, _SUITES, {"columnNameOfCorruptRecord": "_malformed"})
    # Every child of the root counts as a suite, though only real ones hold cases.
    comments = r"(?:<!--(?:(?!-->).)*+-->\s*+)*+"
    first = F.regexp_extract(body, rf"(?s)^\s*+{comments}<([\w:.-]+)", 1)
    closed = F.regexp_extract(body, rf"(?s)</([\w:.-]+)\s*+>\s*+{comments}$", 1)
    alone = F.regexp_extract(body, rf"(?s)<([\w:.-]+)[^<>]*+(?<=/)>\s*+{comments}$", 1)
    parsed = with_once(
        files.withColumns({"_first": first, "_last": F.when(closed == "", alone).otherwise(closed)}), "_document", document
    ).select(
        "path",
        "_first",
        "_last",
        F.col("_document").isNotNull().alias("_known"),
        F.col("_document._malformed").isNotNull().alias("_bad"),
        F.coalesce("_document.testsuite", F.expr(f"CAST(array() AS array<{_SUITE}>)")).alias("_suites"),
    )
    suites = F.col("_suites")
    no_cases = F.array().cast(f"array<{_CASE}>")

    def cases(suite: Column) -> Column:
        return F.coalesce(suite["testcase"], no_cases)

    def is_number(time: Column) -> Column:
        return F.coalesce(time, F.lit("0")).try_cast("double").isNotNull()

    real_first, real_last = F.col("_first") == "testsuite", F.col("_last") == "testsuite"
    first_time = F.coalesce(F.when(real_first, F.get(suites, F.lit(0))["_time"]), F.lit("0"))
    times_fit = is_number(first_time) & F.forall(
        suites, lambda s: F.forall(cases(s), lambda c: is_number(c["_time"]))
    )
    converted = F.coalesce(F.col("_known") & ~F.col("_bad") & (F.col("_first") != "") & times_fit, F.lit(False))

    def suite_name(suite: Column) -> Column:
        return F.coalesce(suite["_name"], F.lit(DEFAULT_SUITE))

    tests = F.flatten(
        F.transform(suites, lambda s: F.transform(cases(s), lambda c: _case_test(c, suite_name(s))))
    ).cast(f"array<{REPORT_TEST}>")
    return parsed.select(
        "path",
        converted.alias("converted"),
        F.when(converted, (first_time.try_cast("double") * 1000).cast("bigint")).alias("stop"),
        F.when(converted & real_last, suite_name(F.try_element_at(suites, F.lit(-1))))
        .when(converted, DEFAULT_SUITE)
        .alias("project"),
        F.when(converted, tests).alias("tests"),
    )


def conversion_counts(converted: DataFrame) -> DataFrame:
    """Converted files and errors."""
    return converted.agg(
        F.count_if("converted").alias("converted"),
        F.count_if(~F.col("converted")).alias("errors"),
        F.count("*").alias("files"),
    )


def _status_count(tests: Column, status: str) -> Column:
    return F.size(F.filter(tests, lambda t: t["status"] == status)).cast("bigint")


def junit_documents(converted: DataFrame, tool: str) -> DataFrame:
    """One report document per converted file, as ``(path, document)``."""
    tests = F.col("tests")
    zero = F.lit(0).cast("bigint")
    report = F.struct(
        F.lit(REPORT_FORMAT).alias("reportFormat"),
        F.lit(SPEC_VERSION).alias("specVersion"),
        F.struct(
            F.struct(F.lit(tool).alias("name")).alias("tool"),
            F.struct(
                F.size(tests).cast("bigint").alias("tests"),
                *[_status_count(tests, s).alias(s) for s in ("passed", "failed", "skipped")],
                zero.alias("pending"),
                zero.alias("other"),
                zero.alias("start"),
                F.col("stop").alias("stop"),
            ).alias("summary"),
            tests.alias("tests"),
            F.struct(F.col("project").alias("projectName")).alias("environment"),
        ).alias("results"),
    )
    return converted.where("converted").select(
        F.regexp_replace("path", r"\.xml$", ".json").alias("path"), F.to_json(report).alias("document")
    )


def report_tests(converted: DataFrame) -> DataFrame:
    """The tests of converted files, one row each, numbered within their file."""
    return converted.select("path", F.posexplode("tests").alias("_pos", "t")).select(
        "path", (F.col("_pos") + 1).alias("seq"), "t.*"
    )


def status_counts(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Report counters per ``keys``; the total includes skipped tests."""
    status = F.col("status")
    return tests.groupBy(*keys).agg(
        F.count("*").alias("tests"),
        *[F.count_if(status == s).alias(s) for s in ("passed", "failed", "skipped")],
    )


def lint_tests(
    findings: DataFrame,
    external: DataFrame,
    custom_suite: str = "Custom Rules",
    external_suite: str = "External Linter",
) -> DataFrame:
    """Lint findings as failed tests, external ones first (``seq_tool``)."""
    name = F.concat(F.lit("["), F.col("rule"), F.lit("] "), F.col("description")).alias("name")
    place = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))

    def rows(df: DataFrame, order: int, suite: str, message: Column) -> DataFrame:
        return df.select(
            F.lit(order).alias("seq_tool"),
            "file",
            "line",
            "rule",
            name,
            F.lit("failed").alias("status"),
            F.lit(0).cast("bigint").alias("duration"),
            message.alias("message"),
            F.lit(suite).alias("suite"),
        )

    return rows(external, 1, external_suite, place).unionByName(
        rows(findings, 2, custom_suite, F.concat(place, F.lit(" — "), F.col("text")))
    )


def array_document(
    items: DataFrame, key: str, order: list[str], item: Column, head: Column, foot: Column, facts: list[Column]
) -> DataFrame:
    """Documents with one long array, as ordered lines ``(key, part, *order, line)``.

    A report may hold a large share of all rows, so it is never collected
    into one value. Head and foot come from ``facts`` aggregated per key
    (partial sums before the shuffle); every array element is a line of its
    own. Lines sorted by key, part and order make up the documents. ``order``
    must tell the items of a key apart.
    """
    # A struct is never NULL itself, so that items with a NULL key stay in the join.
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    keyed = items.withColumn("_key", F.struct(key))
    totals = keyed.groupBy("_key").agg(F.min(position).alias("_first"), *facts).withColumn(
        key, F.col(f"_key.{key}")
    )
    blanks = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in order]
    ends = totals.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), head.alias("line")),
                F.struct(F.lit(2).alias("part"), foot.alias("line")),
            )
        ).alias("_end"),
    ).select(key, F.col("_end.part").alias("part"), *blanks, F.col("_end.line").alias("line"))
    comma = F.when(position == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    lines = keyed.join(totals.select("_key", "_first"), "_key").select(
        key, F.lit(1).alias("part"), *order, F.concat(comma, item).alias("line")
    )
    return ends.unionByName(lines)


def report_lines(
    tests: DataFrame, key: str, order: list[str], tool: str, environment: dict[str, Column] | None = None,
    start: Column | None = None, stop: Column | None = None,
) -> DataFrame:
    """Test rows as report documents in lines, one document per ``key``."""
    zero = F.lit(0).cast("bigint")
    status = F.col("status")
    facts = [
        F.count("*").alias("_tests"),
        *[F.count_if(status == s).alias(f"_{s}") for s in ("passed", "failed", "skipped")],
    ]
    summary = F.to_json(
        F.struct(
            F.col("_tests").alias("tests"),
            *[F.col(f"_{s}").alias(s) for s in ("passed", "failed", "skipped")],
            zero.alias("pending"),
            zero.alias("other"),
            (zero if start is None else start).alias("start"),
            (zero if stop is None else stop).alias("stop"),
        )
    )
    head = F.concat(
        F.lit(f'{{"reportFormat":"{REPORT_FORMAT}","specVersion":"{SPEC_VERSION}","results":{{"tool":'),
        F.to_json(F.struct(F.lit(tool).alias("name"))),
        F.lit(',"summary":'),
        summary,
        F.lit(',"tests":['),
    )
    foot = F.lit("]}}")
    if environment:
        details = F.to_json(F.struct(*[c.alias(n) for n, c in environment.items()]))
        foot = F.concat(F.lit('],"environment":'), details, F.lit("}}"))
    item = F.to_json(F.struct("name", "status", "duration", "message", "suite"))
    return array_document(tests, key, order, item, head, foot, facts)


def issue_lines(issues: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Issue rows as issue documents in lines, one document per ``key``."""
    item = F.to_json(
        F.struct(
            F.col("engine_id").alias("engineId"),
            F.col("rule_id").alias("ruleId"),
            "severity",
            "type",
            F.struct(
                "message",
                F.col("file_path").alias("filePath"),
                F.struct(F.col("start_line").alias("startLine")).alias("textRange"),
            ).alias("primaryLocation"),
        )
    )
    return array_document(issues, key, order, item, F.lit(ISSUES_HEAD), F.lit(ISSUES_FOOT), [])


def write_report_files(lines: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Write every document into a folder of its own, ``path/key=.../``.

    The lines of all documents are sorted over tasks, so that a long document spans part
    files in order; joined by name, the part files of a folder are its document. A short
    document is one file, except where the range of a task ends in it.
    """
    ordered = lines.orderBy(key, "part", *order).select(key, "line")
    ordered.write.mode("overwrite").partitionBy(key).text(path)


def write_document_files(lines: DataFrame, path: str, key: str, order: list[str], suffix: str = ".json") -> None:
    """Write every document as one file, ``path/<key><suffix>``; documents of other keys stay.

    The lines are sorted over tasks and written as ``write_report_files`` does, beside the target. Then
    the part files of a document are put together by name. Only documents in which the range of a
    task ends have several, so there are at most as many of them as tasks; the others
    are renamed.
    """
    spark = lines.sparkSession
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    write_report_files(lines, staged, key, order)
    for folder in places.entries(spark, staged):
        if folder.folder:
            parts = [e.path for e in places.files_below(spark, folder.path)]
            name = folder.name.removeprefix(f"{key}=")
            places.join_files(spark, parts, f"{path.rstrip('/')}/{name}{suffix}")
    places.delete(spark, staged)


def _document_name(suffix: str) -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), re.escape(suffix) + "$", "").alias("name")


def read_document_files(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """``(name, document)`` of the files in a folder, one row per file."""
    text = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return text.select(_document_name(suffix), F.col("value").alias("document"))


def read_report_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``(key, document)`` of what ``write_report_files`` has written; for documents that fit in a row."""
    pieces = spark.read.text(path, wholetext=True).select(
        key, F.col("_metadata.file_name").alias("_file"), "value"
    )
    # Spark's part files are named in the order of their tasks.
    ordered = F.array_sort(F.collect_list(F.struct("_file", "value")))
    joined = F.array_join(F.transform(ordered, lambda p: p["value"]), "")
    return pieces.groupBy(key).agg(joined.alias("document"))


_ISSUE = (
    "struct<engineId:string,ruleId:string,severity:string,type:string,"
    "primaryLocation:struct<message:string,filePath:string,textRange:struct<startLine:bigint>>>"
)
ISSUE_SCHEMA = f"issues array<{_ISSUE}>"


def parse_issues(documents: DataFrame) -> DataFrame:
    """The issues of issue documents, one row each, beside the other columns."""
    others = [c for c in documents.columns if c != "document"]
    return _issue_columns(
        documents.select(*others, F.explode(F.from_json("document", ISSUE_SCHEMA)["issues"]).alias("i")), others
    )


def read_issue_files(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """The issues of a folder of documents as ``issue_lines`` makes them, one row each, beside the ``name`` of their file.

    Every issue is a line, so a task reads a part of a document, however long that is. Lines that belong to no such
    document are errors; documents in another layout are read whole, by ``read_document_files`` and ``parse_issues``.
    """
    line = F.col("value")
    ends = line.isin(ISSUES_HEAD, ISSUES_FOOT)
    # A document on one line is well-formed, but no issue.
    wrong = line.startswith(ISSUES_HEAD) & ~ends
    text = spark.read.option("pathGlobFilter", f"*{suffix}").option("lineSep", "\n").text(path)
    issues = text.where(F.when(wrong, F.raise_error(F.lit("a document is not in lines")).cast("boolean")).otherwise(~ends))
    issue = F.from_json(F.ltrim(line, F.lit(",")), _ISSUE, {"mode": "FAILFAST"})
    return _issue_columns(issues.select(_document_name(suffix), issue.alias("i")), ["name"])


def _issue_columns(each: DataFrame, others: list[str]) -> DataFrame:
    return each.select(
        *others,
        F.col("i.engineId").alias("engine_id"),
        F.col("i.ruleId").alias("rule_id"),
        "i.severity",
        "i.type",
        F.col("i.primaryLocation.message").alias("message"),
        F.col("i.primaryLocation.filePath").alias("file_path"),
        F.col("i.primaryLocation.textRange.startLine").alias("start_line"),
    )


def parse_reports(documents: DataFrame) -> DataFrame:
    """Report documents as columns; one that is no document gives NULLs."""
    others = [c for c in documents.columns if c != "document"]
    return documents.select(*others, F.from_json("document", REPORT_SCHEMA).alias("r")).select(*others, "r.*")
