"""Rain queries: features, climatology, trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rain as R
from ..operators import series as Se
from .fixtures import Tables
from .registry import query
from .twins import twin

ISSUED = "1998-03-01"


def txt(c):
    return F.col(c).cast("string").alias(c)


def r6(c, name=None, n=6):
    e = F.col(c) if isinstance(c, str) else c
    return F.round(e, n).alias(name or c)


@query("alert_days", "F1 F2 G2 J1 N3 I22", twin("""
SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (WHERE trigger >= 0.90e0) AS n_alert,
  round(avg(trigger), 6) AS mean_trigger FROM trig GROUP BY day""", "trig"))
def alert_days(spark, sf):
    t = Se.season_trigger(Tables(spark, sf).readings())
    return t.groupBy("day").agg(
        F.count_if(F.col("trigger") >= 0.90).alias("n_alert"), r6(F.avg("trigger"), "mean_trigger")
    ).select(txt("day"), "n_alert", "mean_trigger")


@query("dense_calendar", "F1", twin("SELECT station, CAST(day AS VARCHAR) AS day, mm FROM rain", "rain"))
def dense_calendar(spark, sf):
    return Tables(spark, sf).rain().select("station", txt("day"), "mm")


@query("trailing_sums", "F2", twin("""
SELECT station, CAST(day AS VARCHAR) AS day, mm AS r1,
 CASE WHEN n >= 3 THEN sum(mm) OVER (w ROWS 2 PRECEDING) END AS r3,
 CASE WHEN n >= 7 THEN sum(mm) OVER (w ROWS 6 PRECEDING) END AS r7,
 CASE WHEN n >= 15 THEN sum(mm) OVER (w ROWS 14 PRECEDING) END AS r15,
 CASE WHEN n >= 30 THEN sum(mm) OVER (w ROWS 29 PRECEDING) END AS r30
FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS n FROM rain)
WINDOW w AS (PARTITION BY station ORDER BY day)""", "rain"))
def trailing_sums(spark, sf):
    t = R.trailing_sums(Tables(spark, sf).rain())
    return t.select("station", txt("day"), "r1", "r3", "r7", "r15", "r30")


@query("trailing_max", "F3", twin("""
SELECT station, CAST(day AS VARCHAR) AS day, CASE WHEN row_number() OVER w >= 30 THEN max(mm) OVER (w ROWS 29 PRECEDING) END AS rmax_30
FROM rain WINDOW w AS (PARTITION BY station ORDER BY day)""", "rain"))
def trailing_max(spark, sf):
    return R.trailing_max(Tables(spark, sf).rain()).select("station", txt("day"), "rmax_30")


@query("wet_day_count", "F4", twin("""
SELECT station, CAST(day AS VARCHAR) AS day, CAST(CASE WHEN row_number() OVER w >= 30 THEN
 sum(CASE WHEN mm > 1 THEN 1 ELSE 0 END) OVER (w ROWS 29 PRECEDING) END AS DOUBLE) AS wetdays_30
FROM rain WINDOW w AS (PARTITION BY station ORDER BY day)""", "rain"))
def wet_day_count(spark, sf):
    return R.wet_days(Tables(spark, sf).rain()).select("station", txt("day"), F.col("wetdays_30").cast("double"))


@query("antecedent_index", "F5", twin("""
SELECT station, CAST(DATE '1970-01-01' + CAST(d AS INT) AS VARCHAR) AS day, round(CASE WHEN t >= 29 THEN api END, 6) AS api FROM rec""",
 "rain", recursive=True, extra={
 "seq": "SELECT station, date_diff('day', DATE '1970-01-01', day) AS d, mm, row_number() OVER (PARTITION BY station ORDER BY day) - 1 AS t FROM rain",
 "rec(station, d, t, api)": """SELECT station, d, t, mm FROM seq WHERE t = 0
   UNION ALL SELECT s.station, s.d, s.t, s.mm + 0.92e0 * r.api FROM rec r JOIN seq s ON s.station = r.station AND s.t = r.t + 1"""}))
def antecedent_index(spark, sf):
    a = Se.rain_series(Tables(spark, sf).readings(), (), peak=None, wet_window=None, curve=None)
    return a.select("station", txt("day"), r6("api"))


STORM = {
 "isl": "SELECT *, sum(CASE WHEN mm > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY day) AS g FROM rain",
 "storm": """SELECT station, day, mm, CASE WHEN mm > 1 THEN count(*) FILTER (WHERE mm > 1) OVER w ELSE 0 END AS storm_dur,
   CASE WHEN mm > 1 THEN coalesce(sum(mm) FILTER (WHERE mm > 1) OVER w, 0) ELSE 0.0 END AS storm_rain FROM isl
   WINDOW w AS (PARTITION BY station, g ORDER BY day)""",
 "ratio": """SELECT *, CASE WHEN storm_dur > 0 THEN (storm_rain / (storm_dur * 24.0e0)) / (2.20e0 * pow(storm_dur * 24.0e0, -0.44e0)) ELSE 0.0e0 END AS storm_id_ratio FROM storm""",
}


@query("storm_runs", "F6", twin("SELECT station, CAST(day AS VARCHAR) AS day, storm_dur, storm_rain FROM storm", "rain", extra=STORM))
def storm_runs(spark, sf):
    s = Tables(spark, sf).storms()
    return s.select("station", txt("day"), F.col("storm_dur").cast("long"), "storm_rain")


@query("storm_id_ratio", "F7", twin("""SELECT station, CAST(day AS VARCHAR) AS day, round(storm_id_ratio, 6) AS ratio_low,
 round(CASE WHEN storm_dur > 0 THEN (storm_rain / (storm_dur * 24.0e0)) / (14.82e0 * pow(storm_dur * 24.0e0, -0.39e0)) ELSE 0.0e0 END, 6) AS ratio_high
 FROM ratio""", "rain", extra=STORM))
def storm_id_ratio(spark, sf):
    s = Tables(spark, sf).storms()
    return s.select(
        "station", txt("day"),
        r6("storm_id_ratio", "ratio_low"),
        r6(R.id_ratio(F.col("storm_dur"), F.col("storm_rain"), "caine1980"), "ratio_high"),
    )


@query("storm_stats", "F8", twin("""SELECT round(avg(CASE WHEN storm_id_ratio > 1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS share_over_curve,
 round(avg(CASE WHEN storm_dur > 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS share_in_storm,
 round(avg(storm_dur) FILTER (WHERE storm_dur > 0), 6) AS mean_dur, max(storm_dur) AS max_dur,
 round(avg(storm_rain) FILTER (WHERE storm_dur > 0), 6) AS mean_rain, max(storm_rain) AS max_rain FROM ratio""", "rain", extra=STORM))
def storm_stats(spark, sf):
    t = R.storm_stats(Tables(spark, sf).storms())
    return t.select(r6("share_over_curve"), r6("share_in_storm"), r6("mean_dur"), F.col("max_dur").cast("long"), r6("mean_rain"), "max_rain")


@query("rain_features", "F2 F3 F4 F5 F6 F7", twin("""SELECT r.station, CAST(r.day AS VARCHAR) AS day, r.mm, r.mm AS r1,
 CASE WHEN n >= 3 THEN sum(r.mm) OVER (w ROWS 2 PRECEDING) END AS r3, CASE WHEN n >= 7 THEN sum(r.mm) OVER (w ROWS 6 PRECEDING) END AS r7,
 CASE WHEN n >= 15 THEN sum(r.mm) OVER (w ROWS 14 PRECEDING) END AS r15, CASE WHEN n >= 30 THEN sum(r.mm) OVER (w ROWS 29 PRECEDING) END AS r30,
 CASE WHEN n >= 30 THEN max(r.mm) OVER (w ROWS 29 PRECEDING) END AS rmax_30,
 CAST(CASE WHEN n >= 30 THEN sum(CASE WHEN r.mm > 1 THEN 1 ELSE 0 END) OVER (w ROWS 29 PRECEDING) END AS DOUBLE) AS wetdays_30,
 round(CASE WHEN n >= 30 THEN api END, 6) AS api, q.storm_dur, q.storm_rain, round(q.storm_id_ratio, 6) AS storm_id_ratio
 FROM seq r JOIN rec ON rec.station = r.station AND rec.n = r.t JOIN ratio q ON q.station = r.station AND q.day = r.day WINDOW w AS (PARTITION BY r.station ORDER BY r.day)""",
 "rain", recursive=True, extra=dict(STORM, **{
 "seq": "SELECT station, day, mm, row_number() OVER (PARTITION BY station ORDER BY day) AS t FROM rain",
 "rec(station, n, api)": "SELECT station, t, mm FROM seq WHERE t = 1 UNION ALL SELECT s.station, s.t, s.mm + 0.92e0 * r.api FROM rec r JOIN seq s ON s.station = r.station AND s.t = r.n + 1"})))
def rain_features(spark, sf):
    f = Se.rain_series(Tables(spark, sf).readings())
    return f.select("station", txt("day"), "mm", "r1", "r3", "r7", "r15", "r30", "rmax_30", F.col("wetdays_30").cast("double"), r6("api"),
                    F.col("storm_dur").cast("long"), "storm_rain", r6("storm_id_ratio"))


@query("date_features", "F9", twin("""SELECT CAST(day AS VARCHAR) AS day, CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month,
 CAST(dayofyear(day) AS INT) AS doy, CASE WHEN month(day) BETWEEN 5 AND 10 THEN 1 ELSE 0 END AS monsoon,
 round(sin(2 * pi() * dayofyear(day) / 365.25e0), 6) + 0.0e0 AS doy_sin, round(cos(2 * pi() * dayofyear(day) / 365.25e0), 6) + 0.0e0 AS doy_cos FROM cal""", "cal"))
def date_features(spark, sf):
    d = R.date_features(R.calendar(Tables(spark, sf).readings()))
    return d.select(txt("day"), "year", "month", "doy", "monsoon", r6("doy_sin"), r6("doy_cos"))


@query("climate_index_join", "F10", twin("""SELECT CAST(year(day) AS INT) AS year, count(*) AS days, count(oni) AS matched, round(avg(oni), 6) AS mean_oni
 FROM cal LEFT JOIN oni ON oni.year = year(day) AND oni.month = month(day) GROUP BY 1""", "cal", "oni"))
def climate_index_join(spark, sf):
    t = Tables(spark, sf)
    j = R.join_climate_index(R.date_features(R.calendar(t.readings())), t.oni())
    return j.groupBy("year").agg(F.count(F.lit(1)).alias("days"), F.count("oni").alias("matched"), r6(F.avg("oni"), "mean_oni"))


ANN = {"ann": """SELECT station, sum(total) / count(*) AS annual_mm FROM (SELECT station, year(day) AS y, sum(mm) AS total FROM rain GROUP BY 1, 2) GROUP BY 1"""}


@query("annual_climate", "F11", twin("""SELECT CAST(floor(lat / 1.0e0) AS BIGINT) AS band, round(avg(annual_mm), 6) AS band_mm, count(*) AS n_stations
 FROM ann JOIN stations USING (station) GROUP BY 1""", "rain", "stations", extra=ANN))
def annual_climate(spark, sf):
    t = Tables(spark, sf)
    b = R.latitude_bands(R.mean_annual(t.rain()), t.stations(), 1.0)
    return b.select("band", r6("band_mm"), "n_stations")


@query("south_north_ratio", "F11", twin("""SELECT round(avg(annual_mm) FILTER (WHERE lat < mid) / avg(annual_mm) FILTER (WHERE lat >= mid), 6) AS south_over_north,
 (SELECT station FROM ann ORDER BY annual_mm DESC, station LIMIT 1) AS wettest, round(max(annual_mm), 6) AS wettest_mm
 FROM ann JOIN stations USING (station), (SELECT (min(lat) + max(lat)) / 2 AS mid FROM stations)""", "rain", "stations", extra=ANN))
def south_north_ratio(spark, sf):
    t = Tables(spark, sf)
    b = R.south_north_ratio(R.mean_annual(t.rain()), t.stations())
    return b.select(r6("south_over_north"), "wettest", r6("wettest_mm"))


@query("monthly_mean", "F12", twin("SELECT CAST(month(day) AS INT) AS month, round(avg(mm), 6) AS mean_mm FROM rain GROUP BY 1", "rain"))
def monthly_mean(spark, sf):
    return R.monthly_mean(Tables(spark, sf).rain()).select("month", r6("mean_mm"))


@query("season_totals", "F13", twin("SELECT station, sum(mm) AS season_mm FROM rain WHERE month(day) BETWEEN 5 AND 10 GROUP BY 1", "rain"))
def season_totals(spark, sf):
    return R.season_totals(Tables(spark, sf).rain())


@query("daily_spread", "F13", twin("SELECT CAST(day AS VARCHAR) AS day, round(avg(mm), 6) AS mean_mm, max(mm) AS max_mm FROM rain GROUP BY 1", "rain"))
def daily_spread(spark, sf):
    return R.daily_spread(Tables(spark, sf).rain()).select(txt("day"), r6("mean_mm"), "max_mm")


PEAK = {"pk": """SELECT year, avg(p) AS mean_peak FROM (SELECT station, CAST(year(day) AS INT) AS year, max(r7) AS p FROM rolled
   WHERE month(day) BETWEEN 5 AND 10 GROUP BY 1, 2) GROUP BY 1"""}


@query("season_peak_rank", "F14 J5", twin("""SELECT year, round(mean_peak, 6) AS mean_peak, CAST(rank() OVER (ORDER BY mean_peak DESC) AS INT) AS rank,
 round((mean_peak - avg(mean_peak) OVER ()) / stddev_pop(mean_peak) OVER (), 6) AS z FROM pk""", "rolled", extra=PEAK))
def season_peak_rank(spark, sf):
    return R.season_peak_rank(Tables(spark, sf).rolled()).select("year", r6("mean_peak"), "rank", r6("z"))


@query("top_peak_years", "F14 J7", twin("SELECT year, round(mean_peak, 6) AS mean_peak FROM pk ORDER BY mean_peak DESC, year LIMIT 5", "rolled", extra=PEAK))
def top_peak_years(spark, sf):
    p = R.season_peak_rank(Tables(spark, sf).rolled())
    return p.orderBy(F.desc("mean_peak"), "year").limit(5).select("year", r6("mean_peak"))


@query("archive_timeline", "F15", twin("""SELECT CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, count(DISTINCT day) AS days,
 CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, round(avg(CASE WHEN mm IS NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS null_share
 FROM (SELECT s.station, c.day, o.mm FROM (SELECT DISTINCT station FROM rain_obs) s CROSS JOIN cal c LEFT JOIN rain_obs o ON o.station = s.station AND o.day = c.day)
 GROUP BY 1, 2""", "rain_obs", "cal"))
def archive_timeline(spark, sf):
    d = R.timeline(R.densify(Tables(spark, sf).readings(), fill=None))
    return d.select("year", "month", "days", txt("first_day"), txt("last_day"), r6("null_share"))


@query("compare_sources", "F16", twin("""SELECT round(avg(a) / avg(b), 6) AS mean_ratio, round(corr(a, b), 6) AS correlation, count(*) AS n,
 round(quantile_cont(a, 0.9), 6) AS p90_a, round(quantile_cont(b, 0.9), 6) AS p90_b FROM
 (SELECT sum(l_quantity) AS a, sum(l_extendedprice) / 1000 AS b FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""))
def compare_sources(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    a = R.daily_totals(li, "l_suppkey", "l_shipdate", "l_quantity")
    b = R.daily_totals(li, "l_suppkey", "l_shipdate", "l_extendedprice").withColumn("mm", F.col("mm") / 1000)
    c = R.compare_sources(a, b)
    return c.select(r6("mean_ratio"), r6("correlation"), "n", r6("p90_a"), r6("p90_b"))


@query("feature_redundancy", "F17", twin("""SELECT 'r1' AS total, round(corr(rmax_30, r1), 6) AS correlation FROM w UNION ALL
 SELECT 'r3', round(corr(rmax_30, r3), 6) FROM w UNION ALL SELECT 'r7', round(corr(rmax_30, r7), 6) FROM w""", "rolled", extra={
 "w": """SELECT r1, r3, r7, CASE WHEN row_number() OVER w >= 30 THEN max(mm) OVER (w ROWS 29 PRECEDING) END AS rmax_30 FROM rolled
  WINDOW w AS (PARTITION BY station ORDER BY day)"""}))
def feature_redundancy(spark, sf):
    f = R.trailing_max(Tables(spark, sf).rolled())
    return R.feature_redundancy(f, "rmax_30", ["r1", "r3", "r7"]).select("total", r6("correlation"))


@query("series_stats", "F18", """SELECT l_suppkey AS station, max(l_quantity) AS peak, round(avg(l_quantity), 6) AS mean, sum(l_quantity) AS total
 FROM lineitem WHERE l_linenumber % 1 = 0 GROUP BY 1""")
def series_stats(spark, sf):
    li = Tables(spark, sf).raw("lineitem").withColumnRenamed("l_suppkey", "station")
    return R.series_stats(li, "station", "l_linenumber", "l_quantity").select("station", "peak", r6("mean"), "total")


@query("peak_by_lead", "F18", """SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS lead, max(l_quantity) AS peak
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def peak_by_lead(spark, sf):
    t = Tables(spark, sf)
    j = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.peak_by_lead(j, "o_orderdate", "l_shipdate", "l_quantity")


@query("season_percentiles", "J1", twin("""SELECT station, CAST(day AS VARCHAR) AS day, round(r3_pct, 6) AS r3_pct, round(r7_pct, 6) AS r7_pct FROM season""", "season"))
def season_percentiles(spark, sf):
    s = Se.season_history(Tables(spark, sf).readings())
    return s.select("station", txt("day"), r6("r3_pct"), r6("r7_pct"))


CLIM = {"clim": """SELECT station, quantile_cont(r3, list_transform(range(101), i -> i / 100.0e0)) AS b3,
  quantile_cont(r7, list_transform(range(101), i -> i / 100.0e0)) AS b7 FROM rolled WHERE month(day) BETWEEN 5 AND 10 GROUP BY 1"""}


@query("climatology_breaks", "N4", twin("""SELECT station, feature, pos, round(b, 6) AS brk FROM (
 SELECT station, 'r3' AS feature, CAST(unnest(range(101)) AS INT) AS pos, unnest(b3) AS b FROM clim UNION ALL
 SELECT station, 'r7', CAST(unnest(range(101)) AS INT), unnest(b7) FROM clim)""", "rolled", extra={"clim": CLIM["clim"].replace(
 "list_transform(range(101), i -> i / 100.0e0)", "[" + ", ".join(f"{i/100}" for i in range(101)) + "]")}))
def climatology_breaks(spark, sf):
    c = Se.season_breaks(Tables(spark, sf).readings()).unpivot(["station"], ["r3", "r7"], "feature", "breaks")
    return c.select("station", "feature", F.posexplode("breaks").alias("pos", "b")).select("station", "feature", "pos", r6("b", "brk"))


@query("live_trigger", "J2 N3", twin("""SELECT station, CAST(day AS VARCHAR) AS day,
 CASE WHEN r7 IS NOT NULL THEN round((least(len(list_filter(b3, lambda b: b < r3)) / 100.0e0, 1.0e0) + least(len(list_filter(b7, lambda b: b < r7)) / 100.0e0, 1.0e0)) / 2.0e0, 6) END AS trigger
 FROM (SELECT station, day, CASE WHEN r7 IS NULL THEN NULL ELSE r3 END AS r3, r7, b3, b7 FROM rolled JOIN clim USING (station))""", "rolled", extra={"clim": CLIM["clim"].replace(
 "list_transform(range(101), i -> i / 100.0e0)", "[" + ", ".join(f"{i/100}" for i in range(101)) + "]")}))
def live_trigger(spark, sf):
    return Se.live_series(Tables(spark, sf).readings()).select("station", txt("day"), r6("trigger"))


@query("forecast_days_ahead", "G9", twin("""SELECT CAST(day AS VARCHAR) AS day FROM cal WHERE day >= DATE '1998-03-01' ORDER BY day LIMIT 7""", "cal"))
def forecast_days_ahead(spark, sf):
    t = Tables(spark, sf)
    return R.forecast_days(R.calendar(t.readings()), F.lit(ISSUED).cast("date")).select(txt("day"))


@query("forecast_days_past", "G9", twin("SELECT CAST(day AS VARCHAR) AS day FROM cal ORDER BY cal.day DESC LIMIT 7", "cal"))
def forecast_days_past(spark, sf):
    t = Tables(spark, sf)
    return R.forecast_days(R.calendar(t.readings()), F.lit("2050-01-01").cast("date")).select(txt("day"))
