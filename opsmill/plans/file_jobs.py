"""Jobs that begin with files: given tables, written the way files land, and read back.

A landing file holds ``FILE_ROWS`` rows of its table at most, so that no file is long
and the number of files follows the table. Where a reader takes files by their name, every
second file has a name that it must refuse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill import places
from opsmill.operators import assertions, history, lint, reports
from opsmill.operators.lint_rules import rules_for
from opsmill.plans import inputs, oracles
from opsmill.plans.inputs import derive, table
from opsmill.session import fresh_path
from opsmill.sources import files
from opsmill.streaming import refresh

FILE_ROWS = 100

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _landed(spark: SparkSession, sf_dir: str, line: str, name: str, head: str = "", foot: str = "", between: str = "\n") -> str:
    """Folder of files made of a line per row of ``part``; the driver only names them."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"concat({name}) AS file", f"concat({line}) AS line"
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda r: r["line"])
    text = F.concat(F.lit(head), F.array_join(lines, between), F.lit(foot)).alias("value")
    folder = fresh_path(spark, "landing")
    rows.groupBy("file").agg(text).write.partitionBy("file").text(folder)
    places.move_files(spark, f"{folder}/file=*/part-*", f"{folder}/named", lambda parent: parent.removeprefix("file="))
    return f"{folder}/named"


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


_FILE = f"CAST(p_partkey DIV {FILE_ROWS} AS STRING)"
_XML = f"'batch_', {_FILE}, CASE WHEN p_partkey DIV {FILE_ROWS} % 2 = 1 THEN '.txt' ELSE '.xml' END"
_XML_LINE = """'<m id="', CAST(p_partkey AS STRING), '">', p_brand, '</m>'"""


def _message_rows(messages: DataFrame) -> DataFrame:
    return messages.select(
        "file_name", F.length("raw_xml").cast("bigint").alias("characters"), F.md5(F.col("raw_xml").cast("binary")).alias("digest")
    )


@query
def files_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landed(spark, sf_dir, _XML_LINE, _XML, "<Document>", "</Document>")
    return _message_rows(files.read_messages(spark, landing, strip_outer=True))


@query
def files_landing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landed(spark, sf_dir, _XML_LINE, _XML, "<Document>", "</Document>")
    target = fresh_path(spark, "messages")
    stream = refresh.stream_landing(spark, landing).withColumn("raw_xml", F.regexp_extract("raw_xml", "(?s)^<Document>(.*)</Document>", 1))
    writer = stream.writeStream.format("parquet").option("path", target)
    writer.option("checkpointLocation", fresh_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return _message_rows(spark.read.parquet(target))


_SQL = f"CASE WHEN p_partkey DIV {FILE_ROWS} % 2 = 1 THEN 'other_' ELSE 'drop_' END, {_FILE}, CASE WHEN p_partkey DIV {FILE_ROWS} % 2 = 1 THEN '.sqlx' ELSE '.sql' END"
_SQL_LINE = "CASE p_size % 3 WHEN 0 THEN 'DROP TABLE t' WHEN 1 THEN 'DROP TABLE IF EXISTS t' ELSE 'USE ROLE r' END, CAST(p_partkey AS STRING), ';'"


def _script_rows(found: DataFrame) -> DataFrame:
    return found.select(_base(F.col("file")).alias("file"), "rule", "line")


@query
def files_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = files.read_scripts(spark, _landed(spark, sf_dir, _SQL_LINE, _SQL))
    return _script_rows(lint.scan_scripts(scripts.where(files.is_sql_path(F.col("file")))))


@query
def files_script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = files.read_script_lines(spark, _landed(spark, sf_dir, _SQL_LINE, _SQL))
    return _script_rows(lint.scan_lines(lint.number_lines(pieces)))


@query
def files_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that come from a table, on scripts that come from files."""
    rows = [(r.code, r.category, r.severity, r.description, r.pattern) for r in rules_for("core") if r.code in ("DO05", "DO06")]
    catalogue = spark.createDataFrame(rows, "rule string, category string, severity string, description string, pattern string")
    scripts = files.read_scripts(spark, _landed(spark, sf_dir, _SQL_LINE, _SQL))
    return _script_rows(lint.scan_scripts(scripts, lint.rules_from(catalogue)))


_LINT_LINE = """'{"filepath":"src/', CAST(p_partkey AS STRING), '.sql","violations":[{"code":"LT01","description":"', p_brand, '","start_line_no":', CAST(p_size AS STRING), '},{"code":"ZZ1"}]}'"""


@query
def files_lint_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landed(spark, sf_dir, _LINT_LINE, f"'lint_', {_FILE}, '.json'", "[", "]", ",\n")
    return lint.external_findings(files.read_lint_json(spark, landing), category="Other Linter")


_CASE_LINE = """'<testcase name="', p_brand, '" time="0.', CAST(p_size + 10 AS STRING), '">', CASE WHEN p_size % 4 = 0 THEN '<failure message="bad"/>' WHEN p_size % 4 = 1 THEN '<skipped/>' ELSE '' END, '</testcase>'"""


@query
def files_junit(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"CASE WHEN p_partkey DIV {FILE_ROWS} % 2 = 1 THEN 'OTHER_' ELSE 'TEST_' END, {_FILE}, '.xml'"
    landing = _landed(spark, sf_dir, _CASE_LINE, name, '<testsuite name="parts" time="2">', "</testsuite>")
    tests = reports.report_tests(reports.convert_junit(files.read_junit(spark, landing)))
    return tests.withColumn("path", _base(F.col("path")))


_TEST_LINE = """'{"name":"', p_brand, '","status":"', CASE WHEN p_size % 4 = 0 THEN 'failed' ELSE 'passed' END, '","duration":', CAST(p_size AS STRING), '}'"""


@query
def files_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landed(spark, sf_dir, _TEST_LINE, f"'TEST_', {_FILE}, '.json'", '{"results":{"tests":[', "]}}", ",\n")
    past = files.read_reports(spark, landing)
    file = _base(F.col("path"))
    return history.results_of_reports(past, F.lit("2024-01-01"), file).groupBy("test", "run_id", "status").agg(
        F.count("*").alias("results"), F.sum("duration").alias("duration")
    )


_PLAN_LINE = """'{"operation":"', CASE p_size % 3 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'DROP' ELSE 'ALTER' END, '","object_name":"', p_brand, '"}'"""


@query
def files_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landed(spark, sf_dir, _PLAN_LINE, f"'plan_', {_FILE}, '.json'", '{"status":"OK","operations":[', "]}", ",\n")
    plans = files.read_plans(spark, landing)
    each = plans.select(_base(F.col("path")).alias("path"), "status", F.explode("operations").alias("o"))
    return each.groupBy("path", "status", "o.operation").agg(F.count("*").alias("operations"))


_ASSERTION = "CASE WHEN p_size % 4 = 0 THEN '# ' ELSE '' END, p_brand, ' | SELECT ', CAST(p_size AS STRING), ' | ', CAST(p_size AS STRING)"


@query
def files_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landed(spark, sf_dir, _ASSERTION, f"'tests_', {_FILE}, '.sqltest'")
    rows = files.read_assertions(spark, landing)
    return rows.groupBy("seq", "name", "query", "expected").agg(F.count("*").alias("files"))


def _day_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report for each day of events."""
    events = table(spark, sf_dir, "events")
    tests = events.select(
        F.substring(F.col("ts").cast("string"), 1, 10).alias("report"),
        "event_id",
        F.concat(F.lit("test_"), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"),
        F.lit(1).cast("bigint").alias("duration"),
        F.lit("").alias("message"),
        F.lit(assertions.SUITE).alias("suite"),
    )
    return reports.report_lines(tests, "report", ["event_id"], tool="table-checks")


def _report_facts(documents: DataFrame) -> DataFrame:
    names = F.transform("results.tests", lambda t: t["name"])
    return reports.parse_reports(documents).select(
        F.col("report").cast("string").alias("report"),
        F.col("results.summary.tests").alias("tests"),
        F.col("results.summary.failed").alias("failed"),
        F.md5(F.array_join(names, ",").cast("binary")).alias("names"),
    )


@query
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all days written as documents and read back."""
    folder = fresh_path(spark, "reports")
    reports.write_report_files(_day_lines(spark, sf_dir), folder, "report", ["event_id"])
    return _report_facts(reports.read_report_files(spark, folder, "report"))


@query
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all days, each written as one file and read as one."""
    folder = fresh_path(spark, "documents")
    reports.write_document_files(_day_lines(spark, sf_dir), folder, "report", ["event_id"])
    return _report_facts(reports.read_document_files(spark, folder).withColumnRenamed("name", "report"))


@query
def issue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of external findings, a file for each kind of event, read back."""
    facts = derive(table(spark, sf_dir, "events"), inputs.EXTERNAL_FACTS)
    parsed = derive(facts, inputs.EXTERNAL_JSON).select(F.from_json("document", files.LINT_SCHEMA).alias("d")).select("d.*")
    issues = lint.external_issues(parsed).withColumn("report", F.regexp_extract("file_path", r"/([a-z]+)_[^/]*$", 1))
    order = ["file_path", "message", "start_line", "rule_id"]
    folder = fresh_path(spark, "issues")
    reports.write_document_files(reports.issue_lines(issues, "report", order), folder, "report", order)
    found = reports.read_issue_files(spark, folder)
    return found.groupBy(F.col("name").alias("report"), "severity", "rule_id").agg(
        F.count("*").alias("issues"), F.sum("start_line").alias("lines"), F.count_distinct("file_path").alias("files")
    )


def _sql(line: str) -> str:
    """An expression of the fixtures for the checking engine."""
    return line.replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")


_PARTS = f"parts AS (SELECT *, {_sql(_FILE)} AS file_no, row_number() OVER (PARTITION BY p_partkey // {FILE_ROWS} ORDER BY p_partkey) AS nth FROM part)"
_MESSAGES = f"""
WITH lines AS (SELECT concat({_sql(_XML)}) AS file_name, string_agg(concat({_sql(_XML_LINE)}), chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1)
SELECT file_name, length(text) AS characters, md5(text) AS digest FROM lines WHERE file_name LIKE '%.xml'
"""
_SCRIPTS = f"""
WITH {_PARTS}
SELECT concat('drop_', file_no, '.sql') AS file, CASE WHEN p_size % 3 = 0 THEN 'DO05' ELSE 'DO06' END AS rule, nth AS line
FROM parts WHERE p_partkey // {FILE_ROWS} % 2 <> 1 AND p_size % 3 <> 1
"""
_REPORT_FACTS = """
SELECT strftime(ts, '%Y-%m-%d') AS report, count(*) AS tests, count(*) FILTER (WHERE event_type = 'error') AS failed,
  md5(string_agg(concat('test_', CAST(user_id AS VARCHAR)), ',' ORDER BY event_id)) AS names
FROM events GROUP BY 1
"""
ORACLES = {
    "files_messages": _MESSAGES,
    "files_landing_stream": _MESSAGES,
    "files_scripts": _SCRIPTS,
    "files_script_lines": _SCRIPTS,
    "files_rule_table": _SCRIPTS,
    "files_lint_json": """
SELECT concat('src/', CAST(p_partkey AS VARCHAR), '.sql') AS file, 'LT01' AS rule, 'Other Linter' AS category, p_brand AS description, CAST(p_size AS BIGINT) AS line FROM part
UNION ALL SELECT concat('src/', CAST(p_partkey AS VARCHAR), '.sql'), 'ZZ1', 'Other Linter', '', CAST(0 AS BIGINT) FROM part
""",
    "files_junit": f"""
WITH {_PARTS}
SELECT concat('TEST_', file_no, '.xml') AS path, CAST(nth AS INTEGER) AS seq, p_brand AS name,
  CASE WHEN p_size % 4 = 0 THEN 'failed' WHEN p_size % 4 = 1 THEN 'skipped' ELSE 'passed' END AS status,
  CAST((p_size + 10) * 10 AS BIGINT) AS duration, CASE WHEN p_size % 4 = 0 THEN 'bad' ELSE '' END AS message, 'parts' AS suite
FROM parts WHERE p_partkey // {FILE_ROWS} % 2 <> 1
""",
    "files_reports": f"""
WITH {_PARTS}
SELECT p_brand AS test, concat('TEST_', file_no, '.json') AS run_id, CASE WHEN p_size % 4 = 0 THEN 'failed' ELSE 'passed' END AS status,
  count(*) AS results, CAST(sum(p_size) AS BIGINT) AS duration FROM parts GROUP BY ALL
""",
    "files_plans": f"""
WITH {_PARTS}
SELECT concat('plan_', file_no, '.json') AS path, 'OK' AS status,
  CASE p_size % 3 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'DROP' ELSE 'ALTER' END AS operation, count(*) AS operations FROM parts GROUP BY ALL
""",
    "files_assertions": f"""
WITH {_PARTS}
SELECT CAST(nth AS INTEGER) AS seq, concat(CASE WHEN p_size % 4 = 0 THEN '# ' ELSE '' END, p_brand, ' ') AS name,
  concat(' SELECT ', CAST(p_size AS VARCHAR), ' ') AS query, concat(' ', CAST(p_size AS VARCHAR)) AS expected, count(*) AS files
FROM parts GROUP BY ALL
""",
    "issue_files": f"""
WITH {oracles.EXTERNAL}, issues AS ({oracles.ISSUES})
SELECT regexp_extract(file_path, '/([a-z]+)_[^/]*$', 1) AS report, severity, rule_id, count(*) AS issues,
  CAST(sum(start_line) AS BIGINT) AS lines, count(DISTINCT file_path) AS files
FROM issues GROUP BY ALL
""",
    "report_documents": _REPORT_FACTS,
    "report_files": _REPORT_FACTS,
}
