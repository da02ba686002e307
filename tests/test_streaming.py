import time
from dataclasses import replace
from graphlib import CycleError

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from opsmill.operators import payments, readings
from opsmill.plans import inputs
from opsmill.session import materialize
from opsmill.streaming import graph, refresh, runs


def same(one, two):
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


@pytest.fixture()
def raw(spark, sf_dir):
    whole = materialize(inputs.messages(inputs.table(spark, sf_dir, "orders")))
    return whole.where("length(raw_xml) % 5 = 0")


def test_landing_folder(spark, tmp_path):
    landing, target, progress = (str(tmp_path / n) for n in ("landing", "target", "progress"))
    (tmp_path / "landing").mkdir()
    for n in range(3):
        (tmp_path / "landing" / f"pacs008_{n}.xml").write_text(f"<a>\n<b><c>{n}</c><d>2024-01-01T00:00:0{n}</d></b><e/></a>")
        stream = refresh.stream_landing(spark, landing)
        refresh.maintain_transfers(stream, target, progress, lag=None).awaitTermination()
        assert sorted(r["message_id"] for r in spark.read.parquet(target).collect()) == [str(i) for i in range(n + 1)]


def test_hourly_in_batches(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("source", "target", "progress"))
    schema = "sensor_id bigint, reading_value decimal(18,6), reading_ts timestamp"
    whole = spark.range(600).selectExpr(
        "id % 3 AS sensor_id", "CAST(id AS DECIMAL(18,6)) AS reading_value",
        "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * ((id * 7919) % 20000) AS reading_ts",
    )
    for part in range(3):
        whole.where(F.col("reading_value") % 3 == part).write.mode("append").parquet(source)
        stream = refresh.stream_table(spark, source, schema)
        refresh.maintain_hourly(stream, target, progress, lag=None).awaitTermination()
    assert same(
        refresh.current_hourly(spark, target).select("sensor_id", "hour_ts", "avg_value", "cnt"),
        readings.hourly_means(whole).select("sensor_id", "hour_ts", "avg_value", "cnt"),
    )


def test_status_join_with_late_acknowledgements(spark, tmp_path, raw):
    paths = {n: str(tmp_path / n) for n in ("transfers", "acks", "target", "progress")}
    half = F.xxhash64("source_filename") % 2 == 0
    transfers, acks = payments.parse_transfers(raw), payments.parse_acknowledgements(raw)
    steps = [
        {"transfers": transfers.where(half)},
        {"acks": acks},
        {"transfers": transfers.where(~half), "acks": acks.where(half).limit(0)},
        {},
    ]
    for name, df in (("transfers", transfers), ("acks", acks)):
        df.limit(0).write.parquet(paths[name])
    kept_number = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for number, step in enumerate(steps, 1):
            for name, df in step.items():
                df.write.mode("append").parquet(paths[name])
            # Each run starts again, and with another number of partitions.
            spark.conf.set("spark.sql.shuffle.partitions", str(2 * number))
            refresh.maintain_status_join(
                refresh.stream_table(spark, paths["transfers"], transfers.schema),
                refresh.stream_table(spark, paths["acks"], acks.schema),
                paths["target"], paths["progress"], lag=None,
            ).awaitTermination()
            landed = [spark.read.parquet(paths[n]) for n in ("transfers", "acks")]
            batch = payments.join_status(*landed)
            kept = refresh.current_status_join(spark, paths["target"])
            assert same(kept.select(*batch.columns).drop("joined_at"), batch.drop("joined_at")), number
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept_number)
    assert not kept.where("pacs002_file IS NOT NULL").isEmpty()
    assert not kept.where("pacs002_file IS NULL").isEmpty()


def test_a_batch_writes_what_is_new_and_its_matches(spark, tmp_path, raw):
    paths = {n: str(tmp_path / n) for n in ("transfers", "acks", "target", "progress")}
    transfers, acks = payments.parse_transfers(raw), payments.parse_acknowledgements(raw)
    transfers.write.parquet(paths["transfers"])
    acks.limit(0).write.parquet(paths["acks"])

    def run():
        query = refresh.maintain_status_join(
            refresh.stream_table(spark, paths["transfers"], transfers.schema),
            refresh.stream_table(spark, paths["acks"], acks.schema),
            paths["target"], paths["progress"], lag=None,
        )
        query.awaitTermination()
        return spark.read.parquet(paths["target"]).count()

    before = run()
    assert before == spark.read.parquet(paths["transfers"]).count()
    joined = payments.join_status(transfers, acks.limit(3)).where("pacs002_file IS NOT NULL")
    acks.limit(3).write.mode("append").parquet(paths["acks"])
    assert run() - before <= max(3, joined.count()) * 50 and run() == run()


def test_hourly_runs_follow_the_hours_not_the_batches(spark, tmp_path):
    target = str(tmp_path / "target")
    table = refresh.hourly_table(spark, target)
    sizes, expected = [], {}
    for batch in range(50):
        hours = [(s, f"2024-01-01 {h:02}:00:00", float(batch * 100 + s * 10 + h), batch) for s in range(3) for h in range(batch % 4, 24, 4)]
        expected |= {(s, h): (v, c) for s, h, v, c in hours}
        rows = spark.createDataFrame(hours, "sensor_id bigint, hour_ts string, avg_value double, cnt bigint")
        version = table.commit(rows, batch)
        assert table.commit(rows.limit(0), batch) == version  # given again
        sizes.append((len(version.runs), sum(r.size for r in version.runs)))
        if batch in (0, 7, 49):
            found = {(r["sensor_id"], r["hour_ts"]): (r["avg_value"], r["cnt"]) for r in refresh.current_hourly(spark, target).collect()}
            assert found == expected
    # 72 hours in all, in at most as many runs as halving allows, whatever the number of batches.
    assert max(n for n, _ in sizes) <= 4
    assert max(b for _, b in sizes) <= 4 * max(b for _, b in sizes[:8])
    stored = [p for p in (tmp_path / "target").iterdir() if p.name.startswith("run=")]
    assert len(stored) <= 2 * 5 + 2
    # A reader that holds the version before still finds its files.
    assert all(not table.rows([run], rows.schema).isEmpty() for run in table.version(back=1).runs)


def test_a_writer_that_stopped_leaves_nothing_behind(spark, tmp_path):
    table = refresh.hourly_table(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "h", 1.0, 1)], "sensor_id bigint, hour_ts string, avg_value double, cnt bigint")
    rows.write.parquet(str(tmp_path / "run=half"))  # written, but no version names it
    with pytest.raises(FileNotFoundError):
        table.read()
    table.commit(rows, 0)
    assert table.read().count() == 1 and not (tmp_path / "run=half").exists()


def test_lags_are_passed_on(spark, tmp_path):
    def nothing(batch):
        raise AssertionError

    tables = [
        graph.Maintained("report", ("hours", "joined"), nothing, 600),
        graph.Maintained("joined", ("left", "right"), nothing, 3600),
        graph.Maintained("hours", (graph.BASE,), nothing, 60),
        graph.Maintained("left", (graph.BASE,), nothing),
        graph.Maintained("right", (graph.BASE, "left"), nothing, 7200),
    ]
    made = graph.RefreshGraph(spark, str(tmp_path), tables)
    assert made.lags() == {"report": 600, "joined": 600, "hours": 60, "left": 600, "right": 600}
    place = {t.name: k for k, t in enumerate(made.order)}
    assert all(place[i] < place[t.name] for t in tables for i in t.inputs if i != graph.BASE)
    with pytest.raises(ValueError):
        graph.RefreshGraph(spark, str(tmp_path), [graph.Maintained("a", ("b",), nothing)])
    with pytest.raises(CycleError):
        graph.RefreshGraph(spark, str(tmp_path), [graph.Maintained("a", ("b",), nothing), graph.Maintained("b", ("a",), nothing)])


@pytest.mark.parametrize("stop_at", ["transfers", "acks", "joined"])
def test_a_graph_goes_on_where_it_stopped(spark, tmp_path, raw, stop_at):
    landing, progress, folder = (str(tmp_path / n) for n in ("landing", "progress", "graph"))
    broken = []

    def tables():
        def stopping(table):
            def added(batch):
                if table.name == stop_at and batch.number == 1 and not broken:
                    broken.append(table.name)
                    raise RuntimeError("stopped")
                return table.added(batch)

            return replace(table, added=added)

        return [stopping(t) for t in refresh.payment_tables()]

    def run():
        made = graph.RefreshGraph(spark, folder, tables())
        stream = refresh.stream_table(spark, landing, refresh.MESSAGE_SCHEMA)
        made.start(stream, progress, once=True).awaitTermination()
        return made

    half = F.xxhash64("file_name") % 2 == 0
    raw.where(half).write.parquet(landing)
    made = run()
    raw.where(~half).write.mode("append").parquet(landing)
    with pytest.raises(StreamingQueryException):
        run()
    batches = {r["name"]: r["batch"] for r in made.status().collect()}
    assert batches["joined"] == 0 and set(batches.values()) <= {0, 1}
    made = run()
    status = made.status().collect()
    assert {r["batch"] for r in status} == {1} and all(r["in_lag"] for r in status)
    assert not any(r["in_lag"] for r in made.status(time.time() + 3700).collect())
    transfers, acks = payments.parse_transfers(raw), payments.parse_acknowledgements(raw)
    assert same(made.read("transfers").select(*transfers.columns).drop("parsed_at"), transfers.drop("parsed_at"))
    joined = payments.join_status(transfers, acks)
    kept = refresh.latest_status(made.read("joined"))
    assert same(kept.select(*joined.columns).drop("joined_at"), joined.drop("joined_at"))
    assert not kept.where("pacs002_file IS NOT NULL").isEmpty()


def test_late_acknowledgements_read_only_the_folders_of_their_messages(spark, tmp_path, raw):
    transfers, acks = payments.parse_transfers(raw), payments.parse_acknowledgements(raw)
    base = transfers.select(F.struct("*").alias("p")).unionByName(acks.select(F.struct("*").alias("a")), allowMissingColumns=True)
    seen = []

    def watched(batch):
        out = refresh._added_status(batch)
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    tables = [
        replace(t, added=watched) if t.name == "joined" else t
        for t in refresh.payment_tables(lambda b: b.where("p IS NOT NULL").select("p.*"), lambda b: b.where("a IS NOT NULL").select("a.*"))
    ]
    made = graph.RefreshGraph(spark, str(tmp_path), tables)
    made.refresh(base.where("p IS NOT NULL"), 0)
    message = payments.join_status(transfers, acks).where("pacs002_file IS NOT NULL").first()["pacs008_message_id"]
    # The acknowledgement comes three batches later.
    made.refresh(base.limit(0), 1)
    made.refresh(base.limit(0), 2)
    made.refresh(base.where(F.col("a.original_message_id") == message), 3)
    pairs = made.read("joined").where("part = 'pair'")
    assert pairs.count() == payments.join_status(transfers, acks).where(
        (F.col("pacs008_message_id") == message) & F.col("pacs002_file").isNotNull()
    ).count() > 0
    bucket = transfers.select(F.pmod(F.xxhash64(F.lit(message)), F.lit(refresh.BUCKETS))).first()[0]
    assert "bucket#" in seen[-1] and f"= {bucket})" in seen[-1] and "PartitionFilters" in seen[-1]


def test_the_status_join_keeps_and_reads_what_it_joins_on(spark, tmp_path, raw):
    transfers, acks = payments.parse_transfers(raw), payments.parse_acknowledgements(raw)
    paths = {n: str(tmp_path / n) for n in ("transfers", "acks", "target", "progress")}
    half = F.xxhash64("source_filename") % 2 == 0

    def refreshed():
        refresh.maintain_status_join(
            refresh.stream_table(spark, paths["transfers"], transfers.schema),
            refresh.stream_table(spark, paths["acks"], acks.schema),
            paths["target"], paths["progress"], lag=None,
        ).awaitTermination()
        batch = payments.join_status(*[spark.read.parquet(paths[n]) for n in ("transfers", "acks")])
        kept = refresh.current_status_join(spark, paths["target"])
        assert same(kept.select(*batch.columns).drop("joined_at"), batch.drop("joined_at"))
        assert not kept.where("pacs002_file IS NOT NULL").isEmpty()

    transfers.where(half).write.parquet(paths["transfers"])
    acks.where(half).write.parquet(paths["acks"])
    # The first batch finds tables as they were written before, with all columns.
    base = spark.read.parquet(paths["transfers"]).select(F.struct("*").alias("p")).unionByName(
        spark.read.parquet(paths["acks"]).select(F.struct("*").alias("a")), allowMissingColumns=True
    )
    tables = refresh.payment_tables(
        lambda b: b.where("p IS NOT NULL").select("p.*"), lambda b: b.where("a IS NOT NULL").select("a.*"),
        folder=paths["target"], merge_below=0,
    )
    graph.RefreshGraph(spark, f"{paths['target']}/_inputs", tables).refresh(base, 0)
    refreshed()
    transfers.where(~half).write.mode("append").parquet(paths["transfers"])
    acks.where(~half).write.mode("append").parquet(paths["acks"])
    refreshed()
    for name, columns in (("transfers", payments.TRANSFER_COLUMNS), ("acks", payments.ACK_COLUMNS)):
        run = runs.RunTable(spark, f"{paths['target']}/_inputs/{name}").version().increment
        assert set(spark.read.parquet(run.path).columns) == {*columns, "bucket"}


def test_a_table_without_runs_is_known_to_be_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "k int, v string")
    none = runs.RunTable(spark, str(tmp_path)).rows([], rows.schema)
    assert none.drop(runs.ORDER).schema == rows.schema and none.isEmpty()
    plan = rows.join(none, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan and "Join" not in plan
