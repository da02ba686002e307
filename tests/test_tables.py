import pytest
from pyspark.sql import functions as F

from opsmill import places
from opsmill.operators import lint, readings, sinks
from opsmill.session import discard, fresh_path, materialize
from opsmill.sources import catalog, files, generators
from opsmill.sources.geo import sensor_places


def test_messages_and_scripts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text("<Document>\n<x>1</x>\n</Document>\n")
    (tmp_path / "sub" / "b.xml").write_text("<Document><x>2</x></Document>")
    (tmp_path / "c.txt").write_text("no")
    rows = {r["file_name"]: r["raw_xml"] for r in files.read_messages(spark, str(tmp_path), True).collect()}
    assert rows == {"a.xml": "<x>1</x>", "b.xml": "<x>2</x>"}
    (tmp_path / "s.sql").write_bytes(b"SELECT \xff1;\r\nUSE ROLE x;")
    (tmp_path / "sub" / "t.sql").write_text("DROP TABLE t;")
    scripts = files.read_scripts(spark, str(tmp_path))
    found = sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["rule"]) for r in lint.scan_scripts(scripts).collect())
    assert found == [("s.sql", 2, "DO06"), ("t.sql", 1, "DO05")]
    text = scripts.where(F.col("file").endswith("s.sql")).first()["text"]
    assert text.startswith("SELECT �1;\r\n")
    one = files.read_scripts(spark, str(tmp_path / "s.sql"))
    assert one.where(files.is_sql_path(F.col("file"))).count() == 1


def test_lines_of_files_read_in_blocks(spark, tmp_path):
    texts = {f"{i}.sql": [f"line {n} of {i} " + "x" * (n % 50) for n in range(400 * i)] for i in (1, 2, 5)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        pieces = files.read_script_lines(spark, str(tmp_path))
        assert pieces.select("file", "block").distinct().count() > 10
        rows = lint.number_lines(pieces).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["text"]) for r in rows)
    assert found == sorted((name, n, line) for name, lines in texts.items() for n, line in enumerate(lines, 1))


def test_csv_stage(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,at\n1,a,2024-01-01\nx,b,2024-01-02\n3,c\n4,d,never\n5,,\n6,f,2024-01-03,extra\n")
    schema = "id int, name string, at date"
    good = files.read_stage_csv(spark, str(tmp_path), schema)
    assert good.count() == 2
    assert sorted(r["id"] for r in good.select("id").collect()) == [1, 5]
    rejects = files.read_stage_csv_with_rejects(spark, str(tmp_path), schema).where("_rejected IS NOT NULL")
    assert sorted(r["_rejected"] for r in rejects.collect()) == ["3,c", "4,d,never", "6,f,2024-01-03,extra", "x,b,2024-01-02"]


def test_lint_json_and_dependencies(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"filepath": "a.sql", "violations": [{"code": "LT01"}]},\n {"filepath": "b.sql"}]')
    assert files.read_lint_json(spark, str(tmp_path / "l.json")).count() == 2
    assert lint.external_findings(files.read_lint_json(spark, str(tmp_path / "l.json"))).count() == 1
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "TEST_a.xml").write_text("<testsuite/>")
    (tmp_path / "x" / "b.xml").write_text("<testsuite/>")
    assert files.read_junit(spark, str(tmp_path)).count() == 1


def test_tables_views_snapshots(spark, tmp_path):
    spark.sql("CREATE DATABASE src")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    sinks.replace_table(df, "src.t", "id bigint, name string, extra date")
    sinks.replace_table(df, "src.t", "id bigint, name string, extra date")
    sinks.insert_into(df.select("name", "id"), "src.t", ["name", "id"])
    sinks.insert_into(spark.range(1).selectExpr("7", "'z'", "DATE '2024-01-01'"), "src.t")
    assert spark.table("src.t").dtypes == [("id", "bigint"), ("name", "string"), ("extra", "date")]
    assert sorted((r["id"], r["name"]) for r in spark.table("src.t").collect()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b"), (7, "z")]
    with pytest.raises(ValueError):
        sinks.insert_into(df, "src.t")
    spark.sql("CREATE VIEW src.v AS SELECT id FROM src.t")
    assert sinks.snapshot_schema(spark, "src", "12") == "src_12"
    sinks.snapshot_schema(spark, "src", "12")
    assert spark.table("src_12.t").count() == 5
    counts = {r["schema_name"]: (r["tables"], r["views"]) for r in catalog.count_objects(spark, "src*").collect()}
    assert counts == {"src": (1, 1), "src_12": (1, 1)}
    sinks.drop_snapshot(spark, "src", "12")
    sinks.drop_snapshot(spark, "src", "12")
    assert [r["schema_name"] for r in catalog.list_schemas(spark, "src*").collect()] == ["src"]
    for release in ("0", "", None):
        with pytest.raises(ValueError):
            sinks.drop_snapshot(spark, "src", release)
    sinks.write_documents(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 2
    assert sinks.stamped(df, "load_ts").where("load_ts IS NOT NULL").count() == 2


def test_readings(spark):
    rows = [(1, 0.5), (111, 0.6), (112, 0.7), (None, 0.8), (1, None)]
    df = spark.createDataFrame(rows, "sensor_id int, sensor_0 double")
    joined = readings.join_places(df, sensor_places(spark))
    assert joined.columns == ["sensor_id", "sensor_0", "city", "latitude", "longitude"]
    assert sorted(r["city"] for r in joined.collect()) == ["Geneva", "Geneva", "Porrentruy"]
    assert sensor_places(spark).count() == 111
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan
    times = spark.createDataFrame([(1, 1.0, "2024-01-01 10:00:00"), (1, 2.0, "2024-01-02 10:00:00"), (1, 3.0, "2024-01-02 09:59:59")],
                                  "sensor_id int, reading_value double, at string")
    times = times.withColumn("reading_ts", F.col("at").cast("timestamp"))
    recent = readings.recent_readings(times, F.lit("2024-01-03 10:00:00").cast("timestamp"))
    assert [r["reading_value"] for r in recent.collect()] == [2.0]


def test_generated_tables(spark):
    df = generators.generate_readings(spark)
    assert df.count() == 5000 and len(df.columns) == 13
    edges = df.agg(F.min("sensor_id"), F.max("sensor_id"), F.min("sensor_2"), F.max("sensor_2")).first()
    assert edges[0] == 1 and edges[1] == 101 and edges[2] >= 100 and edges[3] <= 130
    paid = generators.generate_payments(spark, as_of=F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert paid.count() == 100 and paid.where("currency IS NULL").count() > 0
    assert paid.where("timestamp < '2024-01-01' OR timestamp > '2024-01-02'").isEmpty()


def test_written_intermediates(spark):
    df = materialize(spark.range(10).withColumn("t", F.lit(None).cast("date")))
    assert df.count() == 10 and df.dtypes == [("id", "bigint"), ("t", "date")]
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_a_failed_copy_leaves_the_older_snapshot(spark, tmp_path):
    spark.sql("CREATE DATABASE kept")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").saveAsTable("kept.a")
    spark.sql("COMMENT ON TABLE kept.a IS 'it''s'")
    sinks.snapshot_schema(spark, "kept", "1")
    assert spark.table("kept_1.a").where("p = 1").count() == 2
    assert any(c.name == "p" and c.isPartition for c in spark.catalog.listColumns("kept_1.a"))
    spark.sql("CREATE TABLE kept.b (id BIGINT) USING parquet LOCATION '%s'" % (tmp_path / "b"))
    (tmp_path / "b").mkdir(exist_ok=True)
    (tmp_path / "b" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017
        sinks.snapshot_schema(spark, "kept", "1")
    assert spark.table("kept_1.a").count() == 4
    sinks.drop_snapshot(spark, "kept", "1")
    spark.sql("DROP DATABASE kept CASCADE")


def test_a_release_copies_only_what_has_changed(spark, tmp_path):
    def stored():
        found = {p.relative_to(tmp_path) for p in (tmp_path / "grown.copies" / "tables").rglob("part-*")}
        return {(p.parts[2], p.parts[3]) for p in found}

    spark.sql("CREATE DATABASE grown")
    rows = spark.range(90).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'a b' WHEN 1 THEN 'x=%/+' END AS kind", "id % 2 AS n")
    rows.write.partitionBy("kind", "n").saveAsTable("grown.events")
    rows.write.saveAsTable("grown.whole")
    spark.range(0).write.saveAsTable("grown.none")
    spark.sql("CREATE VIEW grown.odd AS SELECT id FROM grown.events WHERE n = 1")
    sinks.snapshot_schema(spark, "grown", "1", location=str(tmp_path))
    first = stored()
    assert len(first) == 8  # six partitions, the table without, and the empty one
    sinks.snapshot_schema(spark, "grown", "2", location=str(tmp_path))
    assert stored() == first
    spark.sql("INSERT INTO grown.events VALUES (100, 'a b', 1)")
    sinks.snapshot_schema(spark, "grown", "3", location=str(tmp_path))
    assert len(stored() - first) == 1 and first <= stored()
    for release, count in (("1", 90), ("2", 90), ("3", 91)):
        kept = spark.table(f"grown_{release}.events")
        assert kept.count() == count and kept.columns == ["id", "kind", "n"]
        assert kept.where("kind IS NULL").count() == 30 and kept.where("kind = 'x=%/+' AND n = 1").count() == 15
        assert spark.table(f"grown_{release}.odd").count() == count - 45
        assert spark.table(f"grown_{release}.whole").exceptAll(rows).isEmpty()
        assert spark.table(f"grown_{release}.none").columns == ["id"]
    plan = spark.table("grown_3.events").where("n = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(n" in plan
    spark.sql("DROP DATABASE grown CASCADE")
    sinks.drop_snapshot(spark, "grown", "1")
    sinks.drop_snapshot(spark, "grown", "3")
    assert stored() == first
    assert spark.table("grown_2.events").count() == 90 and spark.table("grown_2.odd").count() == 45
    sinks.drop_snapshot(spark, "grown", "2")
    assert stored() == set()


def test_files_are_moved_by_one_listing(spark):
    folder = fresh_path(spark, "many")
    spark.range(60).selectExpr("concat('a_', id, '.txt') AS file", "CAST(id AS STRING) AS value").write.partitionBy("file").text(folder)
    places.move_files(spark, f"{folder}/file=*/part-*", f"{folder}/named", lambda parent: parent.removeprefix("file="))
    found = places.entries(spark, f"{folder}/named")
    assert sorted(e.name for e in found if not e.name.startswith(".")) == sorted(f"a_{k}.txt" for k in range(60))
    assert all(places.read_text(spark, f"{folder}/named/a_{k}.txt").strip() == str(k) for k in (0, 31, 59))
    with pytest.raises(ValueError):
        spark.range(4).repartition(4).selectExpr("'b' AS file", "CAST(id AS STRING) AS value").write.partitionBy("file").text(f"{folder}/twice")
        places.move_files(spark, f"{folder}/twice/file=*/part-*", f"{folder}/other", lambda parent: parent)


def test_a_large_folder_is_copied_by_several_tasks(spark):
    location = fresh_path(spark, "broad")
    name = location.rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{location}'")
    rows = spark.range(0, 150_000, 1, 1).selectExpr("id", "md5(CAST(id AS STRING)) AS text", "'one' AS kind")
    rows.write.partitionBy("kind").saveAsTable(f"`{name}`.facts")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "1m")
    try:
        copy = sinks.snapshot_schema(spark, name, "1", location=f"{location}_1")
    finally:
        spark.conf.unset(size)
    copied = spark.table(f"`{copy}`.facts")
    assert copied.exceptAll(rows).isEmpty() and copied.count() == 150_000
    assert len(copied.inputFiles()) > 1
