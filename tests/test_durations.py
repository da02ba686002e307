import datetime
import random

from pyspark.sql import functions as F

from opsmill.operators import durations


def exact(values, hundredths):
    return sorted(values)[-(-len(values) * hundredths // 100) - 1]


def test_quantiles_are_within_the_stated_error(spark):
    random.seed(3)
    rows = [(f"t{k % 5}", datetime.datetime(2024, 1, 1 + k % 9), int(random.lognormvariate(6, 3))) for k in range(4000)]
    rows += [("t0", rows[0][1], None), ("none", rows[0][1], None), ("large", rows[0][1], 2**62 + 12345), ("below", rows[0][1], -5)]
    days = durations.sketch_days(spark.createDataFrame(rows, "test string, run_ts timestamp, duration bigint"))
    whole = durations.merge_sketches(days, ["test"])
    names = {"p1": 1, "p50": 50, "p90": 90, "p99": 99, "p100": 100}
    found = {r["test"]: r for r in durations.sketch_quantiles(whole, ["test"], names).collect()}
    assert "none" not in found and found["below"]["p50"] == 0
    for test in [f"t{k}" for k in range(5)] + ["large"]:
        values = [d for t, _, d in rows if t == test and d is not None]
        assert found[test]["runs"] == len(values)
        for name, p in names.items():
            low, want = found[test][name], exact(values, p)
            assert low <= want <= low + low // 2 ** (durations.BITS - 1)
    # Rows follow the buckets, not the runs: 64 for each doubling.
    many = spark.range(20_000).selectExpr("'t' AS test", "TIMESTAMP '2024-01-01' AS run_ts", "1024 + id % 1024 AS duration")
    assert durations.sketch_days(many).count() == 64


def test_changes_of_the_median(spark):
    rows = []
    for day in range(30):
        for k in range(6):
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=k)
            rows.append(("steady", at, 100 + k))
            rows.append(("slower", at, (100 if day < 15 else 400) + k))
            rows.append(("rare", at, 1 if day < 15 else 1000) if k == 0 and day in (3, 20) else ("steady", at, 100))
    days = durations.sketch_days(spark.createDataFrame(rows, "test string, run_ts timestamp, duration bigint"))
    found = durations.median_changes(days).collect()
    assert {r["test"] for r in found} == {"slower"} and len(found) == 1
    # The median over the next week tips when more than half of it is slow.
    assert found[0]["change"] == "slower" and datetime.date(2024, 1, 12) <= found[0]["day"] <= datetime.date(2024, 1, 16)
    assert durations.median_changes(days.where(F.lit(False))).collect() == []


def test_changes_equal_those_counted_by_hand_and_copy_no_rows(spark):
    random.seed(8)
    start = datetime.date(2024, 1, 1)
    at = [(f"t{random.randrange(4)}", start + datetime.timedelta(days=random.choice((0, 1, 2, 3, 9, 10, 20, 21, 40)))) for _ in range(400)]
    rows = [(t, day, random.choice((1, 5, 90, 5000))) for t, day in at] + [(None, start, 1), ("t0", None, 1)]
    results = spark.createDataFrame([(t, d and datetime.datetime.combine(d, datetime.time(5)), n) for t, d, n in rows], "test string, run_ts timestamp, duration bigint")
    found = durations.median_changes(durations.sketch_days(results))
    wanted = []
    for test in ("t0", "t1", "t2", "t3"):
        mine, last = [(d, int(n) if n < 128 else n - n % 64) for t, d, n in rows if t == test and d], None
        for day in sorted({d for d, _ in mine}):
            before = [n for d, n in mine if 1 <= (day - d).days <= 7]
            after = [n for d, n in mine if 0 <= (d - day).days < 7]
            change, enough = "same", len(before) >= 5 and len(after) >= 5
            if enough:
                b, a = exact(before, 50), exact(after, 50)
                change = "slower" if a * 100 >= b * 150 and a > b else "faster" if b * 100 >= a * 150 and b > a else "same"
            if change != "same" and change != last:
                wanted.append((test, day, b, a, change))
            last = change
    assert wanted and sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    # A sketch row that is copied to all days it counts for makes a task's memory grow by twice the days.
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
