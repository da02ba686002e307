import pytest
from pyspark.sql import functions as F

from opsmill.operators import assertions, reports
from opsmill.operators.assertions import Assertion
from opsmill.sources import files

FILE = """# Test Name | SQL Query | Expected Result
Row count | SELECT COUNT(*) AS result FROM {{PREFIX}}_READINGS; | 53
Sum | SELECT SUM(SENSOR_0) AS result FROM {{PREFIX}}_READINGS WHERE SENSOR_ID = 101; | 26
No NULLs | SELECT COUNT(*) AS RESULT FROM {{PREFIX}}_READINGS WHERE SENSOR_ID IS NULL; | 0
Avg | SELECT AVG(SENSOR_0) AS result FROM {{PREFIX}}_READINGS WHERE SENSOR_ID = 101; | 0.4905660377
Bars | SELECT 'a' || 'b' AS result | ab
Broken | SELECT nothing AS result FROM {{PREFIX}}_READINGS | 1

Last | SELECT 1/0 AS result | 1"""


@pytest.fixture()
def listed(spark, tmp_path):
    path = tmp_path / "checks.sqltest"
    path.write_text(FILE)
    rows = [(101, 0.5)] * 52 + [(101, 0.0)]
    spark.createDataFrame(rows, "SENSOR_ID int, SENSOR_0 double").createOrReplaceTempView("X_READINGS")
    return assertions.assertions_from(files.read_assertions(spark, str(path)))


def test_run(spark, listed):
    results = assertions.run_assertions(spark, listed, {"PREFIX": "X"})
    rows = [(r["name"].strip(), r["status"], r["message"]) for r in results.collect()]
    assert rows == [
        ("# Test Name", "skipped", ""),
        ("Row count", "passed", ""),
        ("Sum", "failed", "Expected '26', got '26.0'"),
        ("No NULLs", "passed", ""),
        ("Avg", "failed", "Expected '0.4905660377', got '0.49056603773584906'"),
        ("Bars", "passed", ""),
        ("Broken", "failed", "Query failed: UNRESOLVED_COLUMN.WITH_SUGGESTION"),
        ("Unnamed Skipped Test", "skipped", ""),
        ("Last", "failed", "Query failed: DIVIDE_BY_ZERO"),
    ]
    assert all((r["duration"] >= 1) == (r["status"] != "skipped") for r in results.collect())
    counts = reports.status_counts(results, ["suite"]).first()
    assert (counts["tests"], counts["passed"], counts["failed"], counts["skipped"]) == (9, 3, 4, 2)


def test_tolerance(spark, listed):
    results = assertions.run_assertions(spark, listed, {"PREFIX": "X"}, tolerance=1e-9)
    assert {r["name"].strip() for r in results.collect() if r["status"] == "failed"} == {"Broken", "Last"}


def test_echo(spark, listed):
    rows = assertions.echo_assertions(spark, listed).collect()
    assert rows[0]["name"] in ("Fake Failing Test", "Fake Passing Test")
    assert {r["status"] for r in rows} == {"passed", "skipped"} and len(rows) == 10


def test_one_table_is_read_once(spark, listed, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("counted")
    checks = [Assertion(f, f"SELECT {f}(id) AS result FROM counted", "9") for f in ("max", "min", "count")]
    plan = assertions.assertion_values(spark, checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mergedValue") >= 1
    assert [r["status"] for r in assertions.run_assertions(spark, checks).collect()] == ["passed", "failed", "failed"]


def test_strict_file_reading(spark, tmp_path):
    path = tmp_path / "a.sqltest"
    path.write_text("a|b|c|d\n|x|y\nlast|1|2")
    strict = files.read_assertions(spark, str(path), strict=True).collect()
    assert [tuple(r) for r in strict] == [(1, "a", "b", "c|d"), (2, "", "x", "y")]
    loose = files.read_assertions(spark, str(path)).collect()
    assert [tuple(r) for r in loose] == [(1, "a", "b|c", "d"), (2, "", "x", "y"), (3, "last", "1", "2")]


def test_first_row_and_missing_column(spark):
    checks = [
        Assertion("first", "SELECT * FROM VALUES (1, 5), (2, 6) AS t(other, Result) ORDER BY other", "5"),
        Assertion("no column", "SELECT 1 AS value", "null"),
        Assertion("no row", "SELECT 1 AS result WHERE 1 = 0", "null"),
    ]
    assert {r["status"] for r in assertions.run_assertions(spark, checks).collect()} == {"passed"}
    assert assertions.run_assertions(spark, []).count() == 0


def test_table_checks(spark):
    df = spark.range(10)
    values = assertions.table_checks(
        df, {"rows": (F.count("*"), "10"), "even": (F.count_if(F.col("id") % 2 == 0), "4")}
    )
    assert [r["status"] for r in assertions.judge(values).orderBy("seq").collect()] == ["passed", "failed"]


def test_durations_are_those_of_each_assertion(spark):
    slow = "SELECT count(*) AS result FROM range(60000000) WHERE sqrt(id) * sin(id) > 2 OR id < 0"
    checks = [assertions.Assertion("slow", slow, "x"), *[assertions.Assertion(f"fast {k}", "SELECT 1 AS result", "1") for k in range(3)]]
    taken = {r["name"]: r["duration"] for r in assertions.run_assertions(spark, checks).collect()}
    assert taken["slow"] > max(v for k, v in taken.items() if k != "slow")
    together = assertions.run_assertions(spark, checks, timed=False).collect()
    assert [r["duration"] for r in together] == [None] * 4 and [r["status"] for r in together] == ["failed", *["passed"] * 3]


def test_more_assertions_than_one_row_holds(spark):
    checks = [assertions.Assertion(f"n{k}", f"SELECT {k} AS result", str(k)) for k in range(130)]
    checks[70] = assertions.Assertion("n70", "SELECT CAST('x' || id AS INT) AS result FROM range(1)", "70")
    rows = assertions.run_assertions(spark, checks, timed=False).collect()
    assert [r["seq"] for r in rows] == list(range(1, 131))
    assert [r["name"] for r in rows if r["status"] != "passed"] == ["n70"]


def test_checks_of_one_table_share_a_scan(spark, tmp_path):
    spark.range(5000).selectExpr("id % 110 AS SENSOR_ID", "CAST(id % 7 AS DOUBLE) AS SENSOR_0").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("iot_raw")
    checks = [
        assertions.Assertion("Row count", "SELECT COUNT(*) AS result FROM {{S}}raw;", "5000"),
        assertions.Assertion("Sum", "SELECT SUM(SENSOR_0) AS result FROM {{S}}RAW WHERE SENSOR_ID = 101;", "136.0"),
        assertions.Assertion("No NULLs", "SELECT COUNT(*) AS Result FROM {{S}}raw WHERE SENSOR_ID IS NULL", "0"),
        assertions.Assertion("Mean", "select CAST(avg(SENSOR_0) AS DECIMAL(9, 2)) as result from {{S}}raw where SENSOR_ID = 101 OR FALSE", "3.02"),
        assertions.Assertion("Fails", "SELECT MAX(SENSOR_ID) AS result FROM {{S}}raw WHERE 1 / (SENSOR_ID - SENSOR_ID) > 0", "1"),
    ]
    values = {"S": "iot_"}
    plan = assertions.assertion_values(spark, checks[:4], values)._jdf.queryExecution().optimizedPlan().toString()
    # All four are values of one merged subquery, hence of one scan.
    assert plan.count("mergedValue") == 4 and "FILTER" in plan
    statuses = {}
    for timed in (True, False):
        rows = assertions.run_assertions(spark, checks, values, timed=timed).collect()
        statuses[timed] = [(r["name"], r["status"], r["message"]) for r in rows]
        assert all(r["duration"] >= 1 if timed else r["duration"] is None for r in rows)
    assert statuses[True] == statuses[False]
    assert [s for _, s, _ in statuses[True]] == ["passed", "passed", "passed", "passed", "failed"]
    assert statuses[True][4][2].startswith("Query failed")
    # What is not one aggregate of one table stays as it is.
    for query in (
        "SELECT COUNT(*) AS result FROM a JOIN b", "SELECT COUNT(*) AS result FROM a, b", "SELECT 1 AS result FROM a",
        "SELECT COUNT(*) AS result FROM a WHERE b IN (SELECT c FROM d)", "SELECT COUNT(*) AS result FROM a GROUP BY b",
        "SELECT COUNT(*) AS result FROM a WHERE b -- c", "SELECT COUNT(*) + 1 AS result FROM a",
    ):
        assert assertions.filtered_aggregate(query) is None
