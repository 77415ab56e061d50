"""Streaming queries over the events table, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TRIGGER_BREAKS
from ..session import scratch_path
from ..streaming import readings as St
from .q_rain import r6, txt
from .registry import query

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


LATE = "event_id % 50 = 7"  # readings that arrive when their days have long been closed


def delivered(spark, sf, repeats: bool = False, late: bool = False):
    """The events table as a folder of delivered files, and the deliveries that are to come: one micro-batch each.

    Two halves by time, the first of them already there; with ``repeats`` the second brings errors of the first again. Then a closing reading far in
    the future, which flushes the last windows. With ``late``, the readings chosen by LATE come only after that.
    Every delivery is a folder of its own that all tasks write to.
    """
    raw = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("station"), "ts", F.col("value").alias("mm"), F.col("event_id").alias("reading_id"), "event_type"
    )
    held = F.expr(LATE.replace("event_id", "reading_id")) if late else F.lit(False)
    # found once: an approximate median depends on the order of its merges, and another one for the second half would lose or repeat what lies between
    half = raw.agg(F.percentile_approx(F.unix_seconds(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_seconds(F.col("ts").cast("timestamp")) <= F.lit(half)
    on_time = raw.where(~held)
    second = on_time.where(~early)
    if repeats:
        second = second.unionByName(on_time.where(early & (F.col("event_type") == "error"))).unionByName(second.where("event_type = 'error'"))
    path = scratch_path(spark, "readings")
    on_time.where(early).write.parquet(f"{path}/a")
    end = raw.agg(F.lit(-1).cast("bigint").alias("station"), F.max("ts").alias("m")).select(
        "station", (F.col("m") + F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit(0.0).alias("mm"), F.lit(-1).cast("bigint").alias("reading_id"), F.lit("end").alias("event_type"))
    coming = {"b": second, "c": end} | ({"d": raw.where(held)} if late else {})
    return path, [lambda name=name, rows=rows: rows.write.parquet(f"{path}/{name}") for name, rows in coming.items()]


STREAM = "station bigint, ts timestamp, mm double, reading_id bigint, event_type string"


def stream_of(spark, path):
    """A stream over delivered files; what a run finds new is one micro-batch."""
    return spark.readStream.schema(STREAM).option("recursiveFileLookup", True).parquet(path)


DAY = "SELECT user_id AS station, CAST(ts AS DATE) AS day, sum(value) AS mm FROM events GROUP BY 1, 2"


@query("stream_daily_totals_late", "T1", f"SELECT station, CAST(day AS VARCHAR) AS day, round(mm, 4) AS mm FROM ({DAY.replace('GROUP', f'WHERE NOT ({LATE}) GROUP')})")
def stream_daily_totals_late(spark, sf):
    path, coming = delivered(spark, sf, late=True)
    s = St.run_to_table(St.daily_totals(stream_of(spark, path)), "daily", coming=coming)
    return s.where("station >= 0").select("station", txt("day"), r6("mm", n=4))


@query("stream_daily_totals", "T1", f"SELECT station, CAST(day AS VARCHAR) AS day, round(mm, 4) AS mm FROM ({DAY})")
def stream_daily_totals(spark, sf):
    path, coming = delivered(spark, sf)
    s = St.run_to_table(St.daily_totals(stream_of(spark, path)), "daily", coming=coming)
    return s.where("station >= 0").select("station", txt("day"), r6("mm", n=4))


@query("stream_trailing_totals", "T2", f"""SELECT station, CAST(CAST(d + k * INTERVAL 1 DAY AS DATE) AS VARCHAR) AS day, round(sum(mm), 4) AS mm FROM (SELECT station, day AS d, mm FROM ({DAY})), (SELECT unnest(range(3)) AS k) GROUP BY 1, 2""")
def stream_trailing_totals(spark, sf):
    path, coming = delivered(spark, sf)
    s = St.run_to_table(St.trailing_totals(stream_of(spark, path), 3), "trailing", coming=coming)
    return s.where("station >= 0").select("station", txt("day"), r6("mm", n=4))


@query("stream_wet_spells", "T3", f"""SELECT station, CAST(min(day) AS VARCHAR) AS first_day, count(*) AS days, round(sum(mm), 4) AS mm FROM (SELECT *, date_diff('day', DATE '2000-01-01', day) - row_number() OVER (PARTITION BY station ORDER BY day) AS g FROM ({DAY}) WHERE mm > 1) GROUP BY station, g""")
def stream_wet_spells(spark, sf):
    # one row per station-day first; the spells then run over those days as a second stream
    path, coming = delivered(spark, sf)
    days = St.run_to_table(St.daily_totals(stream_of(spark, path)), "days", coming=coming)
    path = scratch_path(spark, "dailyreadings")
    d = days.where("station >= 0").select("station", F.col("day").cast("timestamp").alias("ts"), "mm", F.lit(0).cast("bigint").alias("reading_id"), F.lit("d").alias("event_type"))
    d.write.parquet(f"{path}/a")
    d.agg(F.max("ts").alias("m")).select(F.lit(-1).cast("bigint").alias("station"), (F.col("m") + F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit(5.0).alias("mm"), F.lit(-1).cast("bigint").alias("reading_id"), F.lit("end").alias("event_type")).write.parquet(f"{path}/b")
    s = St.run_to_table(St.wet_spells(stream_of(spark, path)), "spells")
    return s.where("station >= 0").select("station", txt("first_day"), "days", r6("mm", n=4))


@query("stream_without_redeliveries", "T4", "SELECT user_id AS station, count(*) AS n, round(sum(value), 4) AS mm FROM events GROUP BY 1")
def stream_without_redeliveries(spark, sf):
    path, coming = delivered(spark, sf, repeats=True)
    s = St.run_to_table(St.without_redeliveries(stream_of(spark, path)), "dedup", coming=coming)
    return s.where("station >= 0").groupBy("station").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("mm"), "mm", 4))


@query("stream_alert_feed", "T5 N17", f"""WITH d AS ({DAY}) SELECT station, CAST(day AS VARCHAR) AS day, round(least(len(list_filter(b, lambda x: x < round(mm, 4))) / 100.0e0, 1.0e0), 6) AS pct, CAST(1 + len(list_filter([{', '.join(map(str, TRIGGER_BREAKS))}], lambda t: t <= least(len(list_filter(b, lambda x: x < round(mm, 4))) / 100.0e0, 1.0e0))) AS INT) AS cls FROM d JOIN (SELECT station, quantile_cont(round(mm, 4), [{', '.join(str(i / 100) for i in range(101))}]) AS b FROM d GROUP BY 1) USING (station)""")
def stream_alert_feed(spark, sf):
    path, coming = delivered(spark, sf)
    e = spark.read.parquet(f"{sf}/events.parquet")
    daily = e.groupBy(F.col("user_id").alias("station"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("mm"))
    clim = daily.groupBy("station").agg(F.percentile("mm", F.array(*[F.lit(i / 100) for i in range(101)])).alias("breaks"))
    feed = St.alert_feed(St.daily_totals(stream_of(spark, path)).withColumn("mm", F.round("mm", 4)), clim)
    out, progress = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-progress")
    St.run_deliveries(lambda: St.append_alerts(feed, out, progress), coming)
    a = spark.read.option("mergeSchema", False).schema("station bigint, day date, mm double, pct double, cls int").parquet(out)
    return a.select("station", txt("day"), r6("pct"), "cls")


CARRIED = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS k FROM ({DAY})), r(station, day, k, api) AS (SELECT station, day, k, mm FROM d WHERE k = 1 UNION ALL
 SELECT d.station, d.day, d.k, d.mm + r.api * pow(0.92e0, date_diff('day', r.day, d.day)) FROM r JOIN d ON d.station = r.station AND d.k = r.k + 1) SELECT station, CAST(day AS VARCHAR) AS day, round(api, 4) AS api FROM r"""


@query("stream_carried_index", "T6", CARRIED)
def stream_carried_index(spark, sf):
    path, coming = delivered(spark, sf)
    days = St.run_to_table(St.daily_totals(stream_of(spark, path)), "days", coming=coming)
    path = scratch_path(spark, "dailytable")
    days.where("station >= 0").write.parquet(path)
    stream = spark.readStream.schema("station bigint, day date, mm double").parquet(path)
    return St.run_to_table(St.carried_index(stream), "carried").select("station", txt("day"), r6("api", n=4))


@query("stream_corrected_index", "T6", CARRIED)
def stream_corrected_index(spark, sf):
    """A third of all days arrives after the others; the corrected table is that of days in order."""
    path, coming = delivered(spark, sf)
    days = St.run_to_table(St.daily_totals(stream_of(spark, path)), "days", coming=coming).where("station >= 0")
    path, late = scratch_path(spark, "dailytable"), F.dayofmonth("day") % 3 == 0
    days.where(~late).write.parquet(f"{path}/a")
    stream = spark.readStream.schema("station bigint, day date, mm double").option("recursiveFileLookup", True).parquet(path)
    rows = St.run_to_table(St.corrected_index(stream, late="60 days"), "corrected", coming=[lambda: days.where(late).write.parquet(f"{path}/b")])
    return St.latest(rows).select("station", txt("day"), r6("api", n=4))


OUTCOMES = """SELECT f.user_id AS station, count(*) AS matches FROM events f JOIN events o ON o.user_id = f.user_id AND f.event_type = 'view' AND o.event_type = 'error' AND o.ts >= f.ts AND o.ts <= f.ts + INTERVAL 7 DAY GROUP BY 1"""


@query("stream_outcome_join", "T7", OUTCOMES)
def stream_outcome_join(spark, sf):
    (path, issued), (other, happened) = delivered(spark, sf), delivered(spark, sf)
    s = stream_of(spark, path)
    f = s.where("event_type = 'view'").select("station", F.col("ts").alias("issued"))
    o = stream_of(spark, other).where("event_type = 'error'").select("station", F.col("ts").alias("happened"))
    j = St.run_to_table(St.match_outcomes(f, o).select("station", "issued", "happened"), "outcomes", coming=[lambda a=a, b=b: (a(), b()) for a, b in zip(issued, happened, strict=True)])
    return j.groupBy("station").agg(F.count(F.lit(1)).alias("matches"))


@query("stream_outcome_counts", "T7", OUTCOMES)
def stream_outcome_counts(spark, sf):
    """The same matches, counted in state: no pair is written."""
    path, coming = delivered(spark, sf)
    s = stream_of(spark, path)
    f = s.where("event_type = 'view'").select("station", F.col("ts").alias("issued"))
    o = s.where("event_type = 'error'").select("station", F.col("ts").alias("happened"))
    c = St.run_to_table(St.counted_outcomes(f, o), "counted", coming=coming)
    return c.groupBy("station").agg(F.sum("matches").alias("matches")).where("matches > 0")
