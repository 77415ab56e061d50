"""Late days correct the carried index."""

from datetime import date, timedelta

from slopecast.session import scratch_path
from slopecast.streaming import readings as St

DAYS = "station long, day date, mm double"


def test_late_days_correct_what_came_before(spark):
    start = date(2024, 1, 1)
    mm = {k: float(k % 5) for k in range(40) if k not in (3, 17)}
    deliveries = [[k for k in mm if k not in (5, 20, 21, 39)], [20, 39], [5, 21]]  # day 5 is older than the window by then
    path = scratch_path(spark, "days")

    def write(i):
        rows = [(s, start + timedelta(k), mm[k] * s) for k in deliveries[i] for s in (1, 2)]
        spark.createDataFrame(rows, DAYS).coalesce(1).write.parquet(f"{path}/{i}")

    write(0)
    stream = spark.readStream.schema(DAYS).option("recursiveFileLookup", True).parquet(path)
    out = St.run_to_table(St.corrected_index(stream, 0.9, window=25, late="90 days"), "late", coming=[lambda: write(1), lambda: write(2)])
    got = {(r.station, (r.day - start).days): r.api for r in St.latest(out).collect()}
    for s in (1, 2):
        value, before = 0.0, None
        for k in sorted(mm):
            value = mm[k] * s + (value * 0.9 ** (k - before) if before is not None else 0.0)
            before = k
            if k > 39 - 25:
                assert abs(got[s, k] - value) < 1e-9
    assert (1, 5) not in got and out.count() > len(got) and out.select("version").distinct().count() == 3


def test_rows_of_a_day_add_up_and_nulls_are_dry(spark):
    rows = [(1, date(2024, 1, 1), 2.0), (1, date(2024, 1, 1), 3.0), (1, date(2024, 1, 3), None)]
    path = scratch_path(spark, "days")
    spark.createDataFrame(rows, DAYS).write.parquet(path)
    out = St.run_to_table(St.corrected_index(spark.readStream.schema(DAYS).parquet(path), 0.5), "few")
    assert {r.day.day: r.api for r in St.latest(out).collect()} == {1: 5.0, 3: 1.25}


def test_outcomes_are_counted_across_runs(spark):
    import random
    from datetime import datetime

    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 2]), start + timedelta(hours=rng.randrange(24 * 20)), rng.choice(["f", "o"])) for i in range(300)]
    rows.append((999, 1, rows[0][2], "o"))
    path = scratch_path(spark, "both")
    cuts = [start, start + timedelta(8), start + timedelta(12), start + timedelta(99)]

    def write(i):
        part = [r for r in rows if cuts[i] - timedelta(0) <= r[2] < cuts[i + 1]]
        spark.createDataFrame(part, "id long, station long, ts timestamp, kind string").coalesce(1).write.parquet(f"{path}/{i}")

    write(0)
    s = spark.readStream.schema("id long, station long, ts timestamp, kind string").option("recursiveFileLookup", True).parquet(path)
    f, o = s.where("kind = 'f'").selectExpr("station", "ts issued"), s.where("kind = 'o'").selectExpr("station", "ts happened")
    out = St.run_to_table(St.counted_outcomes(f, o, "3 days", "1 day"), "counts", coming=[lambda: write(1), lambda: write(2)])
    want = {1: 0, 2: 0}
    for _, a, t, k in rows:
        for _, b, u, m in rows:
            want[a] += k == "f" and m == "o" and a == b and t <= u <= t + timedelta(3)
    assert {r.station: r.n for r in out.groupBy("station").agg({"matches": "sum"}).withColumnRenamed("sum(matches)", "n").collect()} == want
