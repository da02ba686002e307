"""One job per operator, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill import places
from opsmill.functions.text import (
    domain_prefix,
    fill_tight,
    release_name,
    shell_words,
    strip_space,
)
from opsmill.functions.times import minutes_between, report_millis
from opsmill.operators import (
    assertions,
    dependencies,
    deployment,
    durations,
    history,
    lint,
    payments,
    readings,
    reports,
    scripts,
    sinks,
)
from opsmill.operators.lint_rules import rules_for
from opsmill.plans import inputs
from opsmill.plans.inputs import derive, table
from opsmill.session import fresh_path, materialize
from opsmill.sources import catalog, files, generators
from opsmill.sources.geo import sensor_places
from opsmill.sources.loads import StageTable
from opsmill.streaming import refresh
from opsmill.streaming.graph import RefreshGraph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


# Sensor readings


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "events"), inputs.READINGS)


def _hourly_output(hours: DataFrame) -> DataFrame:
    mean = F.round(F.col("avg_value").cast("double"), 6)
    return hours.select("sensor_id", _ntz("hour_ts"), mean.alias("avg_value"), "cnt")


@query
def iot_geo_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = readings.join_places(_readings(spark, sf_dir), sensor_places(spark))
    return joined.select(
        "sensor_id", "sensor_0", "city",
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
    )


@query
def iot_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly_output(readings.hourly_means(_readings(spark, sf_dir)))


@query
def iot_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    recent = readings.recent_readings(_readings(spark, sf_dir), as_of)
    return recent.select(
        "sensor_id", F.col("reading_value").cast("double").alias("reading_value"), "reading_ts"
    )


# Generated rows


@query
def gen_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.add_readings(table(spark, sf_dir, "events"), "event_id", seed=7)


@query
def gen_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    made = generators.add_payments(table(spark, sf_dir, "events"), "event_id", as_of, seed=7)
    return made.withColumn("amount", F.col("amount").cast("double"))


# Dependencies


def _classified(spark: SparkSession, sf_dir: str, base: str | None) -> DataFrame:
    edges = derive(table(spark, sf_dir, "orders"), inputs.DEPENDENCIES)
    return dependencies.classify_dependencies(edges, base)


@query
def deps_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "OPS_PRD")


@query
def deps_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.summarise_dependencies(_classified(spark, sf_dir, None))


@query
def deps_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dependencies.dependency_lines(_classified(spark, sf_dir, None))
    found = lint.scan_lines(lines.withColumn("line", F.lit(1).cast("bigint")))
    return found.groupBy("file", "rule").agg(F.count("*").alias("findings"))


@query
def deps_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = derive(table(spark, sf_dir, "orders"), inputs.DEPENDENCIES)
    path = fresh_path(spark, "deps")
    sinks.write_csv(edges, path)
    return dependencies.classify_dependencies(files.read_dependencies(spark, path))


# Payments


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw messages, made as they are read: they are ten times as long as the rows they come from."""
    return inputs.messages(table(spark, sf_dir, "orders"))


_MESSAGE_FOLDERS: dict[tuple[str, str], str] = {}


def _message_folder(spark: SparkSession, sf_dir: str) -> str:
    """Where the messages of these test tables have landed; one folder serves all streams of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MESSAGE_FOLDERS or not places.exists(spark, f"{_MESSAGE_FOLDERS[key]}/_SUCCESS"):
        path = fresh_path(spark, "messages")
        _messages(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _MESSAGE_FOLDERS[key] = path
    return _MESSAGE_FOLDERS[key]


def _transfer_output(parsed: DataFrame) -> DataFrame:
    amounts = ("group_settlement_amount", "transaction_amount")
    times = ("source_load_timestamp", "creation_datetime")
    return parsed.drop("parsed_at").withColumns(
        {
            **{c: F.col(c).cast("double") for c in amounts},
            **{c: F.col(c).cast("timestamp_ntz") for c in times},
        }
    )


def _ack_output(parsed: DataFrame) -> DataFrame:
    times = (
        "source_load_timestamp", "creation_datetime", "original_creation_datetime", "acceptance_datetime",
    )
    return parsed.drop("parsed_at").withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def _joined_output(joined: DataFrame) -> DataFrame:
    times = ("pacs008_load_timestamp", "pacs002_load_timestamp")
    return joined.drop("joined_at").withColumns(
        {
            "transaction_amount": F.col("transaction_amount").cast("double"),
            **{c: F.col(c).cast("timestamp_ntz") for c in times},
        }
    )


@query
def pay_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _messages(spark, sf_dir)
    routes = {
        "transfer": payments.route(raw, "pacs008", payments.PACS008_ROOT),
        "status": payments.route(raw, "pacs002", payments.PACS002_ROOT),
    }
    both = [
        df.select(F.lit(name).alias("kind"), "file_name") for name, df in routes.items()
    ]
    return both[0].unionByName(both[1])


@query
def pay_parse_008(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfer_output(payments.parse_transfers(_messages(spark, sf_dir)))


@query
def pay_parse_002(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ack_output(payments.parse_acknowledgements(_messages(spark, sf_dir)))


def _parsed_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The parsed tables, written as they are when kept up to date."""
    raw = _messages(spark, sf_dir)
    return (
        materialize(payments.parse_transfers(raw), "transfers"),
        materialize(payments.parse_acknowledgements(raw), "acks"),
    )


@query
def pay_status_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_output(payments.join_status(*_parsed_tables(spark, sf_dir)))


@query
def pay_ack_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = payments.join_status(*_parsed_tables(spark, sf_dir))
    return joined.groupBy("transaction_status_description", "is_target2_payment").agg(
        F.count("*").alias("payments"),
        F.sum("ack_time").alias("minutes"),
        F.max("ack_time").alias("longest"),
    )


# Scripts


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "documents"), inputs.SCRIPTS)


@query
def lint_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.scan_scripts(_scripts(spark, sf_dir))


def _profile(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = lint.scan_scripts(_scripts(spark, sf_dir), rules_for(name))
    return found.select("file", "rule", "severity", "line")


@query
def lint_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "text")


@query
def lint_setup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "setup")


@query
def lint_dcm_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "dcm")


@query
def lint_all_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "all")


@query
def lint_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.scan_statements(_scripts(spark, sf_dir))
    return found.select("file", "rule", "severity", "statement", "line")


@query
def lint_statement_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = derive(table(spark, sf_dir, "documents"), inputs.QUOTED_SCRIPTS)
    return lint.scan_statements(scripts, code=True).select("file", "rule", "severity", "statement", "line")


@query
def lint_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint_summary(lint.scan_scripts(_scripts(spark, sf_dir)))


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = derive(table(spark, sf_dir, "events"), inputs.EXTERNAL_FACTS)
    parsed = derive(facts, inputs.EXTERNAL_JSON).select(
        F.from_json("document", files.LINT_SCHEMA).alias("d")
    )
    return parsed.select("d.*")


@query
def lint_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.external_issues(_external(spark, sf_dir))


@query
def lint_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.external_issues(_external(spark, sf_dir)).groupBy("severity", "rule_id").agg(
        F.count("*").alias("issues")
    )


@query
def lint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint_totals(
        lint.scan_scripts(_scripts(spark, sf_dir)), lint.external_findings(_external(spark, sf_dir))
    )


@query
def lint_report_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = reports.lint_tests(
        lint.scan_scripts(_scripts(spark, sf_dir)), lint.external_findings(_external(spark, sf_dir))
    )
    return tests.select("name", "status", "duration", "message", "suite")


@query
def lint_issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = lint.external_issues(_external(spark, sf_dir)).withColumn(
        "report", F.regexp_extract("file_path", r"^([^_]*)_", 1)
    )
    return reports.issue_lines(issues, "report", ["file_path", "message", "start_line", "rule_id"]).select(
        "report", "part", "line"
    )


# Assertions


@query
def dq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.expr(inputs.ASSERTION_LINE).alias("value"))
    loose = files.split_assertions(lines).withColumn("reading", F.lit("to the last bar"))
    strict = files.split_assertions(lines, strict=True).withColumn("reading", F.lit("third takes the rest"))
    return loose.unionByName(strict)


_ASSERTED = ("events", "orders", "lineitem", "customer")
ASSERTIONS = [
    assertions.Assertion("# Test Name ", "", ""),
    assertions.Assertion("event count", "SELECT COUNT(*) AS result FROM {{PREFIX}}events;", "5000"),
    assertions.Assertion("no missing users", "SELECT COUNT(*) FILTER (WHERE user_id IS NULL) AS result FROM {{PREFIX}}events;", " '0' "),
    assertions.Assertion("users from zero", "SELECT MIN(user_id) AS Result FROM {{PREFIX}}events", "0"),
    assertions.Assertion("quantity of flag A", "SELECT CAST(SUM(l_quantity) AS BIGINT) AS result FROM {{PREFIX}}lineitem WHERE l_returnflag = 'A'", "26"),
    assertions.Assertion("lines without order", "SELECT COUNT(*) AS result FROM {{PREFIX}}lineitem l LEFT ANTI JOIN {{PREFIX}}orders o ON l.l_orderkey = o.o_orderkey", "0"),
    assertions.Assertion("no such segment", "SELECT c_custkey AS result FROM {{PREFIX}}customer WHERE c_mktsegment = 'NONE'", "null"),
    assertions.Assertion("", "", ""),
]


@query
def dq_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = "asserted_"
    for name in _ASSERTED:
        sinks.replace_view(table(spark, sf_dir, name), f"{prefix}{name}")
    values = assertions.assertion_values(spark, ASSERTIONS, {"PREFIX": prefix})
    return assertions.judge(values)


@query
def dq_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    value = F.col("value")
    values = assertions.table_checks(
        events,
        {
            "rows": (F.count("*"), "5000"),
            "sum": (F.round(F.sum(value.cast("decimal(18,2)")).cast("double"), 2), "26"),
            "mean": (F.round(F.avg(value), 4), "27"),
            "missing": (F.count_if(value.isNull()), "0"),
        },
    )
    return assertions.judge(values, tolerance=5.0).select("seq", "name", "status")


@query
def dq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(dq_run(spark, sf_dir), ["suite"])


# Reports


def _junit(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = derive(inputs.dealt(table(spark, sf_dir, "orders"), "o_orderkey"), inputs.JUNIT_FACTS)
    texts = facts.selectExpr("*", *[f"{sql} AS {n}" for n, sql in inputs.JUNIT_TEXTS.items()])
    return reports.convert_junit(derive(texts, inputs.JUNIT_FILES))


@query
def junit_to_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_tests(_junit(spark, sf_dir))


@query
def junit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conversion_counts(_junit(spark, sf_dir))


@query
def junit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.junit_documents(_junit(spark, sf_dir), tool="table-checks")


@query
def junit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(reports.report_tests(_junit(spark, sf_dir)), ["suite"])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "events"), inputs.RESULTS)


@query
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _results(spark, sf_dir).select(
        F.substring(F.col("run_ts").cast("string"), 1, 10).alias("report"),
        "run_id",
        F.col("test").alias("name"),
        "status",
        "duration",
        F.lit("").alias("message"),
        F.lit(assertions.SUITE).alias("suite"),
    )
    return reports.report_lines(
        tests, "report", ["run_id"], tool="table-checks", environment={"projectName": F.col("report")}
    )


@query
def test_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.track_tests(_results(spark, sf_dir))


@query
def test_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    flips = history.status_flips(history.track_tests(_results(spark, sf_dir)))
    return flips.groupBy("test", "change").agg(F.count("*").alias("flips"))


@query
def duration_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every test over all days, from the sketches of its days."""
    days = durations.sketch_days(_results(spark, sf_dir))
    whole = durations.merge_sketches(days, ["test"])
    return durations.sketch_quantiles(whole, ["test"], {"p50": 50, "p90": 90, "p99": 99})


@query
def duration_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = durations.median_changes(durations.sketch_days(_results(spark, sf_dir)))
    return changes.withColumn("day", F.col("day").cast("string"))


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.substring(F.col("run_ts").cast("string"), 1, 10)
    return history.run_totals(_results(spark, sf_dir), day)


@query
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = derive(table(spark, sf_dir, "orders"), inputs.PLAN_FACTS)
    plans = derive(facts, inputs.PLAN_DOCUMENTS).select(
        "plan_id", deployment.parse_plan(F.col("document")).alias("plan")
    )
    return deployment.summarise_plans(plans).withColumn(
        "dropped_objects", F.array_join("dropped_objects", ",")
    )


# Templates, DDL, scalar functions


@query
def render_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    settings = {name: F.expr(sql) for name, sql in inputs.TEMPLATE_SETTINGS.items()}
    pairs = [c for name, value in settings.items() for c in (F.lit(name), value)]
    odd = F.when(F.col("p_partkey") % 2 == 1, F.create_map(F.lit("db"), F.lit("prd")))
    return scripts.render_scripts(
        part.select(
            "p_partkey",
            F.expr(inputs.TEMPLATES["text"]).alias("text"),
            F.create_map(*pairs).alias("defaults"),
            odd.alias("overrides"),
        )
    )


@query
def ddl_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.format_ddl(derive(inputs.dealt(table(spark, sf_dir, "part"), "p_partkey"), inputs.DDL))


@query
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = derive(table(spark, sf_dir, "orders"), {**inputs.PAYMENT_FACTS, "custkey": "o_custkey"})
    k = F.col("k")
    later = F.col("created") + F.expr("INTERVAL '1' SECOND * (k % 500)")
    padded = F.concat(F.lit(" \t"), F.col("debtor"), F.lit("  'x  y' \n"))
    return orders.select(
        "k",
        minutes_between(F.col("created"), later).alias("minutes"),
        domain_prefix(F.concat(F.substring(F.col("debtor"), 1, 3), F.lit("_"), k.cast("string"))).alias("prefix"),
        domain_prefix(F.col("e2e")).alias("no_prefix"),
        release_name(F.col("clearing"), (F.col("custkey") % 3).cast("string")).alias("released"),
        shell_words(padded).alias("words"),
        strip_space(padded).alias("stripped"),
        fill_tight(F.concat(F.col("e2e"), F.lit(" {{A}} {{ A }} {{A}}")), {"A": F.col("txn")}).alias("filled"),
        report_millis((k % 7) / 8).alias("millis"),
    )


# Tables and catalogue


CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal decimal(18,2), c_mktsegment string"


@query
def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    spoiled = customer.withColumn(
        "c_acctbal",
        F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")),
    )
    path = fresh_path(spark, "stage")
    sinks.write_csv(spoiled, path)
    loaded = files.read_stage_csv(spark, path, CUSTOMER_SCHEMA)
    return loaded.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query
def csv_load_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a stage in two parts, each loaded twice: every row once, and what a load did."""
    customer = table(spark, sf_dir, "customer")
    spoiled = customer.withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    )
    stage = fresh_path(spark, "stage")
    loaded = StageTable(spark, fresh_path(spark, "loaded"), CUSTOMER_SCHEMA)
    for half in (0, 1):
        sinks.write_csv(spoiled.where(F.col("c_custkey") % 2 == half), f"{stage}/half_{half}")
        for _ in range(2):
            loaded.load(stage)
    return loaded.read().groupBy("c_mktsegment").agg(
        F.count("*").alias("rows"), F.count_distinct("c_custkey").alias("customers"),
        F.sum("c_acctbal").cast("double").alias("balance"),
    )


def _new_schema(spark: SparkSession, label: str) -> tuple[str, str]:
    location = fresh_path(spark, label)
    name = location.rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{location}'")
    return name, location


@query
def table_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, _ = _new_schema(spark, "inserted")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    target = f"`{schema}`.parties"
    sinks.replace_table(
        customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS kind"),
        target,
        "id bigint, name string, balance decimal(18,2), kind string",
    )
    sinks.insert_into(supplier.select("s_name", "s_suppkey"), target, ["name", "id"])
    sinks.replace_view(spark.table(target), "parties_view", ["party_id", "party_name", "party_balance", "party_kind"])
    return spark.table("parties_view").withColumn("party_balance", F.col("party_balance").cast("double"))


@query
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, location = _new_schema(spark, "snapped")
    for name in ("nation", "customer"):
        table(spark, sf_dir, name).write.saveAsTable(f"`{schema}`.{name}")
    table(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").saveAsTable(f"`{schema}`.orders")
    spark.sql(f"CREATE VIEW `{schema}`.closed AS SELECT * FROM {schema}.orders WHERE o_orderstatus = 'F'")
    spark.sql(f"CREATE VIEW `{schema}`.buyers AS SELECT DISTINCT o_custkey FROM {schema}.closed")
    for _ in range(2):  # the second replaces the first
        copy = sinks.snapshot_schema(spark, schema, "7", location=f"{location}_7")
    spark.sql(f"DROP DATABASE `{schema}` CASCADE")
    counted = [
        spark.table(f"`{copy}`.{t}").select(F.lit(t).alias("table_name")).groupBy("table_name").agg(
            F.count("*").alias("rows")
        )
        for t in ("nation", "customer", "orders", "closed", "buyers")
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def snapshot_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot a schema, run assertions in the snapshot, drop it."""
    schema, location = _new_schema(spark, "released")
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).write.saveAsTable(f"`{schema}`.{name}")
    copy = sinks.snapshot_schema(spark, schema, "3", location=f"{location}_3")
    checks = [
        assertions.Assertion("orders", "SELECT COUNT(*) AS result FROM `{{SCHEMA}}`.orders;", "15000"),
        assertions.Assertion("no negative price", "SELECT COUNT(*) AS result FROM `{{SCHEMA}}`.orders WHERE o_totalprice < 0;", "0"),
        assertions.Assertion("largest line number", "SELECT MAX(l_linenumber) AS result FROM `{{SCHEMA}}`.lineitem;", "7"),
    ]
    results = assertions.run_assertions(spark, checks, {"SCHEMA": copy})
    sinks.drop_snapshot(spark, schema, "3")
    return results.select("seq", "name", "status", "message")


@query
def catalog_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, _ = _new_schema(spark, "listed")
    for name in ("region", "part", "supplier"):
        table(spark, sf_dir, name).write.saveAsTable(f"`{schema}`.{name}")
    spark.sql(f"CREATE VIEW `{schema}`.big_parts AS SELECT * FROM `{schema}`.part WHERE p_size > 25")
    return catalog.count_objects(spark, schema).select("tables", "views")


# Streaming


@query
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir).withColumn("reading_ts", F.col("reading_ts").cast("timestamp"))
    path = fresh_path(spark, "readings")
    rows.write.parquet(path)
    rows = refresh.stream_table(spark, path, rows.schema, files_per_trigger=4)
    target = fresh_path(spark, "hourly")
    refresh.maintain_hourly(rows, target, fresh_path(spark, "progress"), lag=None).awaitTermination()
    return _hourly_output(refresh.current_hourly(spark, target))


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.stream_table(spark, _message_folder(spark, sf_dir), refresh.MESSAGE_SCHEMA, files_per_trigger=8)


@query
def stream_parse_008(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "transfers")
    refresh.maintain_transfers(
        _landed(spark, sf_dir), target, fresh_path(spark, "progress"), lag=None
    ).awaitTermination()
    return _transfer_output(spark.read.parquet(target))


@query
def stream_parse_002(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "acks")
    refresh.maintain_acknowledgements(
        _landed(spark, sf_dir), target, fresh_path(spark, "progress"), lag=None
    ).awaitTermination()
    return _ack_output(spark.read.parquet(target))


@query
def stream_status_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _landed(spark, sf_dir)
    transfers, acks = fresh_path(spark, "transfers"), fresh_path(spark, "acks")
    # Neither reads what the other writes, so the tasks of one fill the cores that a batch of the other leaves idle.
    streams = [
        maintain(landed, path, fresh_path(spark, "progress"), lag=None)
        for maintain, path in ((refresh.maintain_transfers, transfers), (refresh.maintain_acknowledgements, acks))
    ]
    try:
        for stream in streams:
            stream.awaitTermination()
    finally:
        for stream in streams:
            stream.stop()
    target = fresh_path(spark, "joined")
    refresh.maintain_status_join(
        refresh.stream_table(spark, transfers, spark.read.parquet(transfers).schema),
        refresh.stream_table(spark, acks, spark.read.parquet(acks).schema),
        target,
        fresh_path(spark, "progress"),
        lag=None,
    ).awaitTermination()
    return _joined_output(refresh.current_status_join(spark, target))


@query
def stream_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three maintained tables, two of them inputs of the third, fed twice: order, batch, lag and rows."""
    raw, landing = _messages(spark, sf_dir), fresh_path(spark, "landing")
    graph = RefreshGraph(spark, fresh_path(spark, "graph"), refresh.payment_tables())
    progress = fresh_path(spark, "progress")
    for half in (0, 1):
        raw.where(F.pmod(F.xxhash64("file_name"), F.lit(2)) == half).write.mode("append").parquet(landing)
        graph.start(refresh.stream_table(spark, landing, refresh.MESSAGE_SCHEMA), progress, once=True).awaitTermination()
    rows = {"transfers": graph.read("transfers"), "acks": graph.read("acks"), "joined": refresh.latest_status(graph.read("joined"))}
    counts = [df.select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("rows")) for name, df in rows.items()]
    status = graph.status().withColumn("after_inputs", (F.col("place") == 2) == (F.col("name") == "joined"))
    return status.join(reduce(DataFrame.unionByName, counts), "name").select(
        "name", "after_inputs", (F.col("batch") + 1).alias("batches"), F.col("lag").alias("lag_seconds"), "in_lag", "rows"
    )
