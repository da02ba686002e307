import json

import pytest
from pyspark.sql import functions as F

from opsmill.operators import deployment, history, reports
from opsmill.plans import file_jobs
from opsmill.sources import files

CASES = {
    "suites": '<testsuites><testsuite name="A" time="1.5"><testcase name="a" time="0.25"/>'
    '<testcase name="b" time="0"><failure message="m">t</failure></testcase></testsuite>'
    '<testsuite name="B" time="9"><testcase time="2"><skipped message="s"/></testcase></testsuite></testsuites>',
    "suite": '<?xml version="1.0"?>\n<testsuite><testcase name="a"><failure>only text</failure></testcase>'
    '<testcase name="b"><failure/><skipped/></testcase><testcase name="c"><error message="e"/></testcase>'
    '<testcase name="d"><failure message="">t</failure></testcase></testsuite>',
    "no cases": '<testsuite name="E" time="0.5"/>',
    "empty": "<testsuites/>",
    "empty too": "<testsuites></testsuites>",
    "malformed": '<testsuites><testsuite name="A"></testsuites>',
    "not closed": '<testsuites><testsuite name="A"/>',
    "wrong end": '<testsuites><testsuite name="A"/></suites>',
    "other root": '<report><testsuite name="A"/></report>',
    "bad time": '<testsuite name="A"><testcase name="a" time="soon"/></testsuite>',
    "bad suite time": '<testsuite name="A" time="soon"/>',
    "second suite time is not read": '<testsuites><testsuite name="A"/><testsuite name="B" time="x"/></testsuites>',
    "text": "nothing",
}


def test_junit(spark):
    df = spark.createDataFrame([(k + ".xml", v) for k, v in CASES.items()], "path string, xml string")
    rows = {r["path"][:-4]: r for r in reports.convert_junit(df).collect()}
    good = {k for k, r in rows.items() if r["converted"]}
    assert good == {"suites", "suite", "no cases", "second suite time is not read"}
    assert [tuple(t) for t in rows["suites"]["tests"]] == [
        ("a", "passed", 250, "", "A"), ("b", "failed", 1, "m", "A"), ("Unnamed", "skipped", 2000, "s", "B"),
    ]
    assert (rows["suites"]["stop"], rows["suites"]["project"]) == (1500, "B")
    assert [tuple(t)[:4] for t in rows["suite"]["tests"]] == [
        ("a", "failed", 1, "only text"), ("b", "failed", 1, ""), ("c", "passed", 1, ""), ("d", "failed", 1, ""),
    ]
    assert (rows["suite"]["stop"], rows["suite"]["project"]) == (0, "SQLValidation")
    assert (rows["no cases"]["tests"], rows["no cases"]["stop"]) == ([], 500)
    counts = reports.conversion_counts(reports.convert_junit(df)).first()
    assert (counts["converted"], counts["errors"], counts["files"]) == (4, 9, 13)
    documents = {
        r["path"]: json.loads(r["document"])
        for r in reports.junit_documents(reports.convert_junit(df), "tool").collect()
    }
    assert set(documents) == {k + ".json" for k in good}
    assert documents["suites.json"]["results"]["summary"] == {
        "tests": 3, "passed": 1, "failed": 1, "skipped": 1, "pending": 0, "other": 0, "start": 0, "stop": 1500,
    }
    assert reports.report_tests(reports.convert_junit(df)).count() == 7


def result_rows(spark, rows):
    return spark.createDataFrame(
        rows, "report string, seq int, name string, status string, duration bigint, message string, suite string"
    )


def test_documents_of_any_length(spark, tmp_path):
    rows = [("hot" if i % 3 else None, i, f'n"{i}', ["passed", "failed", "skipped"][i % 3], i, "a\nb", "s") for i in range(500)]
    lines = reports.report_lines(result_rows(spark, rows), "report", ["seq"], "tool", {"projectName": F.col("report")})
    path = str(tmp_path / "documents")
    reports.write_report_files(lines, path, "report", ["seq"])
    parts = sorted((tmp_path / "documents" / "report=hot").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    whole = {r["report"]: json.loads(r["document"]) for r in reports.read_report_files(spark, path, "report").collect()}
    assert whole["hot"] == document and set(whole) == {"hot", None}
    wanted = [r for r in rows if r[0] == "hot"]
    assert [t["name"] for t in document["results"]["tests"]] == [r[2] for r in wanted]
    assert document["results"]["summary"]["tests"] == len(wanted)
    assert document["results"]["environment"] == {"projectName": "hot"}
    unnamed = sorted(lines.where("report IS NULL").collect(), key=lambda r: (r["part"], r["seq"] or 0))
    document = json.loads("".join(r["line"] for r in unnamed))
    assert len(document["results"]["tests"]) == sum(r[0] is None for r in rows)


def test_issue_documents(spark):
    issues = spark.createDataFrame(
        [("r", "e", f"C{i}", "MINOR", "CODE_SMELL", f"m {i}", "p.sql", i) for i in range(20)],
        "report string, engine_id string, rule_id string, severity string, type string, message string, file_path string, start_line bigint",
    )
    lines = reports.issue_lines(issues, "report", ["file_path", "start_line"]).collect()
    lines.sort(key=lambda r: (r["part"], r["start_line"] or 0))
    issues = json.loads("".join(r["line"] for r in lines))["issues"]
    assert [i["primaryLocation"]["textRange"]["startLine"] for i in issues] == list(range(20))
    assert issues[3]["engineId"] == "e" and issues[3]["primaryLocation"]["message"] == "m 3"


def test_a_long_issue_document_is_read_in_parts(spark, tmp_path, sf_dir, monkeypatch):
    schema = "report string, engine_id string, rule_id string, severity string, type string, message string, file_path string, start_line bigint"
    rows = [
        ("hot" if i % 9 else f"r{i}", "e", None if i % 5 else "C", "MINOR", "CODE_SMELL", f'm,"{i}\r\n{{"issues":[', ",p.sql", i)
        for i in range(2000)
    ]
    issues = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "issues")
    reports.write_document_files(reports.issue_lines(issues, "report", ["start_line"]), path, "report", ["start_line"])
    names = ["name", *schema.replace(",", "").split()[2::2]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = reports.read_issue_files(spark, path)
        parts = found.where("name = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert sorted(map(str, found.select(names).collect())) == sorted(
            map(str, reports.parse_issues(reports.read_document_files(spark, path)).select(names).collect())
        )
        assert found.count() == len(rows)
        assert len(parts) > 8 and max(r["count"] for r in parts) < 400
        # The job reads its documents so, too.
        whole = []
        monkeypatch.setattr(reports, "read_document_files", lambda *a: whole.append(a))
        assert file_jobs.issue_files(spark, sf_dir).count() > 0 and not whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("document", ['{"issues":[{"engineId":"e"}]}', '{\n"issues":[\n{"engineId":"e"}\n]\n}', '{"issues":[\n{"engineId":\n]}'])
def test_other_documents_are_not_read_in_parts(spark, tmp_path, document):
    (tmp_path / "a.json").write_text(document)
    with pytest.raises(Exception, match="not in lines|MALFORMED"):
        reports.read_issue_files(spark, str(tmp_path)).collect()


def test_history(spark):
    hours = [0, 0, 0, 1, 5, 5, 30]
    states = ["passed", "failed", "failed", "passed", "failed", "skipped", "failed"]
    rows = [
        (test, f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00", i, state, 10 * i)
        for test in ("a", None)
        for i, (h, state) in enumerate(zip(hours, states))
    ] + [("b", None, 1, "passed", 5)]
    df = spark.createDataFrame(rows, "test string, run_ts string, run_id bigint, status string, duration bigint")
    found = history.track_tests(df.withColumn("run_ts", F.col("run_ts").cast("timestamp"))).collect()
    assert len(found) == len(rows)
    for test in ("a", None):
        mine = sorted((r for r in found if r["test"] == test), key=lambda r: r["run_id"])
        assert [r["change"] for r in mine] == [
            "new", "newly_failing", "same", "fixed", "newly_failing", "fixed", "newly_failing",
        ]
        assert [r["runs"] for r in mine] == [1, 2, 3, 4, 5, 6, 7]
        assert [r["passed_runs"] for r in mine] == [1, 1, 1, 2, 2, 2, 2]
        assert [r["duration_change"] for r in mine] == [None, 10, 10, 10, 10, 10, 10]
        assert mine[-1]["pass_rate"] == 2 / 7


def test_past_reports_feed_the_history(spark, tmp_path):
    for n, status in enumerate(["passed", "failed"]):
        folder = tmp_path / f"run{n}"
        folder.mkdir()
        report = {
            "reportFormat": "CTRF",
            "results": {"summary": {"start": n}, "tests": [{"name": "t", "status": status, "duration": 5}]},
        }
        (folder / f"TEST_{n}.json").write_text(json.dumps(report, indent=2))
        (folder / "other.json").write_text("{}")
    past = files.read_reports(spark, str(tmp_path))
    results = history.results_of_reports(
        past, F.timestamp_seconds(F.col("results.summary.start")), F.col("path")
    )
    changes = sorted((r["run_ts"], r["change"]) for r in history.track_tests(results).collect())
    assert [c for _, c in changes] == ["new", "newly_failing"]


def test_plans(spark, tmp_path):
    plan = {"status": "OK", "operations": [{"operation": o, "object_name": o.lower()} for o in ("CREATE", "DROP", "DROP")] + [{"operation": "DROP"}, {"operation": "ALTER"}, {"operation": "NO_OPERATION"}, {"operation": "OTHER"}]}
    (tmp_path / "a.json").write_text(json.dumps(plan, indent=1))
    (tmp_path / "b.json").write_text('{"status": "PLAN_FAILED"}')
    (tmp_path / "c.json").write_text('{"operations": []}')
    plans = files.read_plans(spark, str(tmp_path)).select(
        F.element_at(F.split("path", "/"), -1).alias("path"), F.struct("status", "operations").alias("plan")
    )
    rows = {r["path"]: tuple(r)[1:] for r in deployment.summarise_plans(plans).collect()}
    assert rows == {
        "a.json": ("OK", 1, 1, 3, 1, ["drop", "drop", "unknown"], False),
        "b.json": ("PLAN_FAILED", 0, 0, 0, 0, [], True),
        "c.json": ("UNKNOWN", 0, 0, 0, 0, [], False),
    }


def test_children_that_are_no_suites(spark):
    suite = '<testsuite name="S" time="2"><testcase name="a"/></testsuite>'
    texts = {
        "lead": f"<testsuites><properties><p/></properties>{suite}</testsuites>",
        "trail": f"<testsuites> <!-- x --> {suite}<properties/> <!-- y --></testsuites>",
        "plain": f"<testsuites>{suite}</testsuites>",
        "only": "<testsuites><properties/></testsuites>",
        "none": "<testsuites></testsuites>",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, xml string")
    rows = {r["path"]: (r["converted"], r["stop"], r["project"], r["tests"]) for r in reports.convert_junit(files).collect()}
    assert {k: v[:3] for k, v in rows.items()} == {
        "lead": (True, 0, "S"), "trail": (True, 2000, reports.DEFAULT_SUITE), "plain": (True, 2000, "S"),
        "only": (True, 0, reports.DEFAULT_SUITE), "none": (False, None, None),
    }
    assert [len(rows[k][3]) for k in ("lead", "trail", "only")] == [1, 1, 0]


def test_each_document_is_one_file(spark, tmp_path):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    tests = spark.range(2000).selectExpr(
        "CASE WHEN id < 1900 THEN 'long' ELSE concat('r ', id % 3) END AS report", "id AS seq", "concat('t', id) AS name",
        "'passed' AS status", "id AS duration", "'' AS message", "'s' AS suite",
    )
    lines = reports.report_lines(tests, "report", ["seq"], tool="t").repartition(8)
    path = str(tmp_path / "documents")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for _ in range(2):  # the second replaces the first
            reports.write_document_files(lines, path, "report", ["seq"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    names = sorted(p.name for p in (tmp_path / "documents").iterdir() if not p.name.startswith("."))
    assert names == ["long.json", "r 0.json", "r 1.json", "r 2.json"]
    whole = json.loads((tmp_path / "documents" / "long.json").read_text())
    assert [t["name"] for t in whole["results"]["tests"]] == [f"t{i}" for i in range(1900)]
    found = reports.parse_reports(reports.read_document_files(spark, path)).selectExpr("name", "size(results.tests) AS n")
    assert sum(r["n"] for r in found.collect()) == 2000
    reports.write_document_files(lines.where("report = 'long'").limit(0), path, "report", ["seq"])
    assert len(list((tmp_path / "documents").glob("*.json"))) == 4
