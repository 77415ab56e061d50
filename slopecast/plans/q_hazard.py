"""Hazard queries: landslide and flood outlooks, catchments, backtest."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.classify import trigger_response
from ..operators import aggregates as A
from ..operators import catchment as Ct
from ..operators import evaluate as E
from ..operators import hazard as H
from ..operators import rain as R
from ..operators import series as Se
from ..operators import spatial as S
from ..operators import tables as Tb
from ..session import reused
from . import q_evaluate, q_spatial  # noqa: F401  (register shared SQL)
from .fixtures import Tables
from .q_rain import CLIM, r6, txt
from .registry import query
from .twins import register_cte, twin

ISSUED = "1998-07-01"
register_cte("clim", ("rolled",), CLIM["clim"].replace("list_transform(range(101), i -> i / 100.0e0)", "[" + ", ".join(f"{i/100}" for i in range(101)) + "]"))
register_cte("live", ("rolled", "clim"), f"""SELECT station, day, mm, (least(len(list_filter(b3, lambda b: b < r3)) / 100.0e0, 1.0e0) + least(len(list_filter(b7, lambda b: b < r7)) / 100.0e0, 1.0e0)) / 2.0e0 AS trigger
  FROM rolled JOIN clim USING (station) WHERE day >= DATE '{ISSUED}' AND day < DATE '{ISSUED}' + INTERVAL 7 DAY""")
register_cte("sus", ("cell_rain",), "SELECT cell_id, row, col, rain_id, CASE WHEN lc NOT IN (70, 80, 100) AND slope > 10 THEN slope / 45.0e0 END AS s FROM cell_rain")
register_cte("lsh", ("sus", "live"), """SELECT cell_id, row, col, day, s * trigger AS hazard, CAST(CASE WHEN s * trigger IS NULL THEN 0 ELSE 1 + (s * trigger >= 0.02e0)::INT + (s * trigger >= 0.06e0)::INT + (s * trigger >= 0.15e0)::INT + (s * trigger >= 0.30e0)::INT END AS INT) AS cls
  FROM sus JOIN live ON live.station = sus.rain_id""")
register_cte("anc", ("basins",), """WITH RECURSIVE w(basin, a) AS (SELECT basin, basin FROM basins UNION ALL SELECT w.basin, b.next_down FROM w JOIN basins b ON b.basin = w.a WHERE b.next_down >= 0) SELECT basin, a FROM w""")
register_cte("sig", ("anc", "basins", "live"), """SELECT a AS basin, day, sum(sub_area) AS up_area, sum(mm * sub_area) / sum(sub_area) AS up_mm, sum(trigger * sub_area) / sum(sub_area) AS up_pct
  FROM anc JOIN basins b ON b.basin = anc.basin JOIN live ON live.station = b.rain_pt GROUP BY 1, 2""")
register_cte("fcells", ("cells", "flags"), """SELECT c.cell_id, c.row, c.col, c.partkey % (SELECT count(*) FROM customer) AS basin, CASE WHEN f.cell_id IS NULL THEN 0 ELSE 1 + c.partkey % 254 END AS idx FROM cells c LEFT JOIN flags f USING (cell_id)""")
register_cte("fh", ("fcells", "sig"), """SELECT cell_id, basin, day, idx / 254.0e0 * least(1.0e0, greatest(0.02e0, (up_pct - 0.35e0) / (1.0e0 - 0.35e0))) AS hazard FROM fcells JOIN sig USING (basin) WHERE idx > 0
  UNION ALL SELECT cell_id, basin, day, 0.0e0 FROM fcells, (SELECT DISTINCT day FROM sig) WHERE idx = 0""")
FCLS = "CAST(CASE WHEN coalesce(hazard, 0) = 0 THEN 0 ELSE 1 END + (hazard >= 0.04e0)::INT + (hazard >= 0.10e0)::INT + (hazard >= 0.20e0)::INT + (hazard >= 0.33e0)::INT AS INT)"


class Outlook(Tables):
    """Fixture tables for a seven-day outlook issued on one date."""

    def once(self, name, build):
        """A table written the first time it is asked for."""
        if name not in self.__dict__:
            self.__dict__[name] = reused(build(), name)
        return self.__dict__[name]

    def live(self):
        """The week's rain and trigger: a few rows per station, found in one pass over its days."""
        return self.once("live_week", lambda: Se.live_series(self.readings(), date.fromisoformat(ISSUED), 7))

    def sus(self):
        ok = ~F.col("lc").isin(70, 80, 100) & (F.col("slope") > 10)
        return self.cell_rain().select("cell_id", "row", "col", "rain_id", F.when(ok, F.col("slope") / 45.0).alias("susceptibility"))

    def landslide(self):
        return H.landslide_hazard(self.sus(), self.live())

    def signal(self):
        week = self.live()
        return self.once("upstream_signal", lambda: H.catchment_signal(self.basins(), week.select("station", "day", "mm", "trigger")))

    def fcells(self):
        n = self.raw("customer").agg(F.count(F.lit(1)).alias("n")).scalar()
        f = self.flags().select("cell_id", F.lit(1).alias("f"))
        c = self.cells().withColumn("_n", n).join(f, "cell_id", "left")
        return c.select("cell_id", "row", "col", F.pmod("partkey", "_n").alias("basin"),
                        F.when(F.col("f").isNull(), F.lit(0)).otherwise(F.pmod("partkey", F.lit(254)) + 1).alias("idx"))

    def flood(self):
        return H.flood_hazard(self.fcells(), self.signal())


@query("landslide_hazard", "N5 H4 G5", twin("SELECT cell_id, CAST(day AS VARCHAR) AS day, round(hazard, 6) AS hazard, cls FROM lsh", "lsh"))
def landslide_hazard(spark, sf):
    return Outlook(spark, sf).landslide().select("cell_id", txt("day"), r6("hazard"), "cls")


@query("high_share_by_day", "I21", twin("SELECT CAST(day AS VARCHAR) AS day, round(avg((cls >= 4)::INT), 6) AS high_share FROM lsh WHERE cls > 0 GROUP BY 1", "lsh"))
def high_share_by_day(spark, sf):
    return A.high_share(Outlook(spark, sf).landslide(), "day", "cls").select(txt("day"), r6("high_share"))


@query("statewide_alerts", "I22", twin("SELECT CAST(year(day) AS INT) AS year, count(*) FILTER (WHERE top >= 0.99e0) AS alert_days, count(*) AS days FROM (SELECT day, max(trigger) AS top FROM trig GROUP BY 1) GROUP BY 1", "trig"))
def statewide_alerts(spark, sf):
    return A.statewide_alerts(Se.season_trigger(Tables(spark, sf).readings()), 0.99)


# percentiles are whole 200ths, areas and rain whole numbers: the twin divides integers, half up at the sixth place
SIGNAL = """SELECT basin, day, CAST(den AS DOUBLE) AS up_area, (2000000 * mm + den) // (2 * den) / 1e6 AS up_mm, (2000000 * p + 200 * den) // (400 * den) / 1e6 AS up_pct FROM
 (SELECT a AS basin, CAST(day AS VARCHAR) AS day, CAST(sum(sub_area) AS BIGINT) AS den, CAST(sum(mm * sub_area) AS BIGINT) AS mm, CAST(sum(round(trigger * 200) * sub_area) AS BIGINT) AS p
  FROM anc JOIN basins b ON b.basin = anc.basin JOIN live ON live.station = b.rain_pt GROUP BY 1, 2)"""


@query("catchment_signal", "N1 N6", twin(SIGNAL, "anc", "basins", "live"))
def catchment_signal(spark, sf):
    return Outlook(spark, sf).signal().select("basin", txt("day"), "up_area", r6("up_mm"), r6("up_pct"))


@query("chain_accumulation", "N1", """SELECT c_custkey AS basin, sum(1.0e0 + c_custkey % 97) OVER (ORDER BY c_custkey DESC) AS up_area FROM customer""")
def chain_accumulation(spark, sf):
    b = Tables(spark, sf).chain_basins()
    e = b.select(F.col("basin").alias("node"), F.col("next_down").alias("down"))
    return Ct.accumulate(e, b.select(F.col("basin").alias("node"), F.col("sub_area").alias("up_area")), ["up_area"]).select(F.col("node").alias("basin"), "up_area")


@query("routing_order_check", "N2", twin("""SELECT count(*) AS links, count(*) FILTER (WHERE d.ua <= u.ua) AS violations FROM (SELECT b.basin, b.next_down, t.ua FROM basins b JOIN (SELECT a, sum(sub_area) AS ua FROM anc JOIN basins USING (basin) GROUP BY 1) t ON t.a = b.basin) u
 JOIN (SELECT a AS basin, sum(sub_area) AS ua FROM anc JOIN basins USING (basin) GROUP BY 1) d ON d.basin = u.next_down""", "anc", "basins"))
def routing_order_check(spark, sf):
    b = Tables(spark, sf).basins()
    e = b.select(F.col("basin").alias("node"), F.col("next_down").alias("down"))
    up = Ct.accumulate(e, b.select(F.col("basin").alias("node"), F.col("sub_area").alias("up_area")), ["up_area"])
    full = b.select("basin", "next_down").join(up.withColumnRenamed("node", "basin"), "basin")
    return Ct.order_violations(full, "up_area")


@query("trigger_response", "N7", twin("SELECT basin, CAST(day AS VARCHAR) AS day, round(least(1.0e0, greatest(0.02e0, (up_pct - 0.35e0) / 0.65e0)), 6) AS response FROM sig", "sig"))
def response(spark, sf):
    return Outlook(spark, sf).signal().select("basin", txt("day"), r6(trigger_response(F.col("up_pct")), "response"))


@query("flood_hazard", "N8", twin(f"SELECT cell_id, CAST(day AS VARCHAR) AS day, round(hazard, 6) AS hazard, {FCLS} AS cls FROM fh", "fh"))
def flood_hazard(spark, sf):
    return Outlook(spark, sf).flood().select("cell_id", txt("day"), r6("hazard"), "cls")


@query("flood_share_by_day", "I21", twin(f"SELECT CAST(day AS VARCHAR) AS day, round(avg(({FCLS} >= 4)::INT), 6) AS high_share FROM fh WHERE hazard > 0 GROUP BY 1", "fh"))
def flood_share_by_day(spark, sf):
    return A.high_share(Outlook(spark, sf).flood(), "day", "cls").select(txt("day"), r6("high_share"))


SNAP = {"snap": """SELECT p.cell_id, arg_min(c.cell_id, struct_pack(d := pow(c.row - p.row, 2) + pow(c.col - p.col, 2), r := c.row, c := c.col)) AS at, sqrt(min(pow(c.row - p.row, 2) + pow(c.col - p.col, 2))) AS sd
  FROM sus p JOIN sus c ON c.s IS NOT NULL AND abs(c.row - p.row) <= 10 AND abs(c.col - p.col) <= 10 GROUP BY 1"""}


@query("location_outlook", "N9 E12", twin("""SELECT s.cell_id, round(sd, 6) AS snap_dist, CAST(arg_min(h.day, struct_pack(v := -h.hazard, d := h.day)) AS VARCHAR) AS worst_day, round(max(h.hazard), 6) AS worst
 FROM snap s JOIN lsh h ON h.cell_id = s."at" GROUP BY s.cell_id, sd""", "sus", "lsh", extra={"snap": SNAP["snap"].replace("AS at", 'AS "at"')}))
def location_outlook(spark, sf):
    o = Outlook(spark, sf)
    cells = o.sus()
    snapped = S.snap_within(cells, cells.where(F.col("susceptibility").isNotNull()), "cell_id", 10)
    haz = o.landslide().select("row", "col", "day", "hazard", "cls")
    out = H.location_outlook(cells, snapped, haz, "cell_id")
    worst = H.worst_day(out, "cell_id")
    d = out.groupBy("cell_id").agg(F.first("snap_dist").alias("snap_dist"))
    return worst.join(d, "cell_id").select("cell_id", r6("snap_dist"), txt("worst_day"), r6("worst"))


@query("place_records", "N10 E11", twin("""SELECT p.place_id, round(s.s, 6) AS susceptibility, round(l.trigger, 6) AS trigger, round(s.s * l.trigger, 6) AS hazard, l.mm, f.idx, f.basin, g.up_area, round(g.up_mm, 6) AS up_mm, round(g.up_pct, 6) AS up_pct
 FROM (SELECT partkey AS place_id, cell_id FROM cells) p JOIN sus s USING (cell_id) LEFT JOIN (SELECT * FROM live WHERE day = DATE '1998-07-03') l ON l.station = s.rain_id JOIN fcells f USING (cell_id) LEFT JOIN (SELECT * FROM sig WHERE day = DATE '1998-07-03') g ON g.basin = f.basin""", "cells", "sus", "live", "fcells", "sig"))
def place_records(spark, sf):
    o = Outlook(spark, sf)
    day = F.col("day") == F.lit("1998-07-03").cast("date")
    live = o.live().where(day).select(F.col("station").alias("rain_id"), "trigger")
    mm = o.live().where(day).select(F.col("station").alias("rain_id"), "mm")
    sig = o.signal().where(day).drop("day")
    p = o.cells().select(F.col("partkey").alias("place_id"), "cell_id")
    j = p.join(o.sus().select("cell_id", "rain_id", "susceptibility"), "cell_id").join(live, "rain_id", "left").join(mm, "rain_id", "left")
    j = j.join(o.fcells().select("cell_id", "idx", "basin"), "cell_id").join(sig, "basin", "left")
    return j.select("place_id", r6("susceptibility"), r6("trigger"), r6(F.col("susceptibility") * F.col("trigger"), "hazard"), "mm", "idx", "basin", "up_area", r6("up_mm"), r6("up_pct"))


@query("day_summary", "N11", twin("""SELECT CAST(l.day AS VARCHAR) AS day, count(*) FILTER (WHERE trigger >= 0.9e0) AS points_alert, round(quantile_cont(trigger, 0.5), 6) AS median_trigger, arg_min(station, struct_pack(t := -trigger, s := station)) AS top_point, round(any_value(hs), 6) AS high_share
 FROM live l LEFT JOIN (SELECT day, avg((cls >= 4)::INT) AS hs FROM lsh WHERE cls > 0 GROUP BY 1) h ON h.day = l.day GROUP BY 1""", "live", "lsh"))
def day_summary(spark, sf):
    o = Outlook(spark, sf)
    live = o.live()
    s = H.day_summary(live, A.high_share(H.landslide_hazard(o.sus(), live), "day", "cls"))
    return s.select(txt("day"), "points_alert", r6("median_trigger"), "top_point", r6("high_share"))


@query("watch_list", "N12 I11 J7 G10", twin("""SELECT basin, round(up_pct, 6) AS up_pct, up_area, round(up_mm, 6) AS up_mm, CASE WHEN up_area >= 2000 THEN 'large' ELSE 'watch' END AS tier FROM sig
 WHERE day = DATE '1998-07-03' AND basin IN (SELECT basin FROM fcells WHERE idx > 0) ORDER BY sig.up_pct DESC, basin LIMIT 40""", "sig", "fcells"))
def watch_list(spark, sf):
    o = Outlook(spark, sf)
    sig = o.signal().where(F.col("day") == F.lit("1998-07-03").cast("date"))
    w = H.watch_list(sig.withColumn("up_pct", F.col("up_pct")), o.fcells().where("idx > 0"))
    return w.select("basin", r6("up_pct"), "up_area", r6("up_mm"), "tier")


@query("lead_time_profile", "N13 H5", twin("""SELECT CAST(lead AS INT) AS lead, count(*) AS n, round(avg((trigger >= 0.9e0)::INT), 6) AS share_alert, round(quantile_cont(trigger, 0.5), 6) AS median_trigger, round((SELECT quantile_cont(trigger, 0.5) FROM trig), 6) AS ordinary_median
 FROM (SELECT station, lead, CAST(day + lead * INTERVAL 1 DAY AS DATE) AS day FROM ev, (SELECT unnest(range(-5, 3)) AS lead)) e JOIN trig USING (station, day) GROUP BY 1""", "ev", "trig"))
def lead_time_profile(spark, sf):
    t = Tables(spark, sf)
    p = H.lead_time_profile(Se.season_trigger(t.readings()), t.events())
    return p.select("lead", "n", r6("share_alert"), r6("median_trigger"), r6("ordinary_median"))


CRED = {"b": "SELECT basin, count(*) AS n, avg(idx / 254.0e0) AS pred, avg(label * 1.0e0) AS obs FROM fcells JOIN labelled USING (cell_id) GROUP BY 1",
        "rk": "SELECT rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0e0 AS rp, rank() OVER (ORDER BY obs) + (count(*) OVER (PARTITION BY obs) - 1) / 2.0e0 AS ro FROM b",
        "px": "SELECT label, rank() OVER (ORDER BY idx) + (count(*) OVER (PARTITION BY idx) - 1) / 2.0e0 AS r FROM fcells JOIN labelled USING (cell_id)"}


@query("label_credibility", "N14 I5 I10 M17", twin("""SELECT CAST(sum(label) AS BIGINT) AS flooded, round(avg((slope > 15)::INT) FILTER (WHERE label = 1), 6) AS over_15, round(avg((slope > 25)::INT) FILTER (WHERE label = 1), 6) AS over_25,
 round((SELECT (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0e0) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label))) FROM px), 9) AS pixel_auc, round((SELECT corr(rp, ro) FROM rk), 9) AS basin_rho, (SELECT count(*) FROM rk) AS n_basins FROM labelled""", "fcells", "labelled", extra=CRED))
def label_credibility(spark, sf):
    o = Outlook(spark, sf)
    lab = o.labelled().select("cell_id", "slope", "label")
    j = o.fcells().join(lab, "cell_id")
    per = j.groupBy("basin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("idx") / 254.0).alias("pred"), F.avg(F.col("label") * 1.0).alias("obs"))
    rho = E.spearman(per, "pred", "obs")
    s = A.share_over(lab.where("label = 1"), "slope", [15, 25])
    return (s.select(r6("over_15"), r6("over_25"))
            .withColumn("flooded", lab.agg(F.sum("label").cast("long").alias("n")).scalar())
            .withColumn("pixel_auc", F.round(E.auc(j, "idx", "label").select("auc").scalar(), 9))
            .withColumn("basin_rho", F.round(rho.select("rho").scalar(), 9))
            .withColumn("n_basins", rho.select("n").scalar()))


@query("unit_rollup", "N15", twin("""SELECT fid, round(avg((hazard >= 0.3e0)::INT), 6) AS alert_share, count(*) FILTER (WHERE hazard >= 0.3e0 AND d2 <= 9) AS alert_near, count(*) AS cells
 FROM inpoly JOIN (SELECT cell_id, max(coalesce(hazard, 0)) AS hazard FROM lsh GROUP BY 1) USING (cell_id) JOIN near USING (cell_id) GROUP BY 1""", "inpoly", "lsh", "near"))
def unit_rollup(spark, sf):
    from ..operators.terrain import nearest_flag
    o = Outlook(spark, sf)
    inside = S.fill_polygons(o.verts())
    haz = o.landslide().groupBy("cell_id", "row", "col").agg(F.max(F.coalesce("hazard", F.lit(0.0))).alias("hazard"))
    dist = nearest_flag(o.cells(), o.flags()).select("cell_id", "dist")
    j = inside.join(haz, ["row", "col"]).join(dist, "cell_id")
    u = H.unit_rollup(j, "fid", F.col("hazard") >= 0.3, F.col("dist") <= 3)
    return u.select("fid", r6("alert_share"), "alert_near", "cells")


@query("gauge_labels", "N16", twin("""SELECT station, CAST(day AS VARCHAR) AS day, peak, round(warning, 6) AS warning, CASE WHEN peak >= warning THEN 1 ELSE 0 END AS flood_day FROM (SELECT station, day, mm AS peak FROM rain_obs) JOIN
 (SELECT station, quantile_cont(mm, 0.95) AS warning FROM rain_obs GROUP BY 1) USING (station)""", "rain_obs"))
def gauge_labels(spark, sf):
    return H.gauge_labels(Tables(spark, sf).rain_obs(), 0.95).select("station", txt("day"), "peak", r6("warning"), "flood_day")


@query("event_dropouts", "H3", twin("""SELECT CAST(0 AS INT) AS step, 'all' AS name, count(*) AS n FROM ev UNION ALL SELECT 1, 'known station', count(*) FROM ev WHERE station IN (SELECT station FROM rain_obs)
 UNION ALL SELECT 2, 'rain on the day', count(*) FROM ev SEMI JOIN rain_obs r ON r.station = ev.station AND r.day = ev.day""", "ev", "rain_obs"))
def event_dropouts(spark, sf):
    t = Tables(spark, sf)
    obs = t.rain_obs()
    return Tb.dropout_counts(t.events(), [("known station", obs.select("station").distinct(), ["station"]), ("rain on the day", obs, ["station", "day"])])


@query("forecast_archive", "N17", twin("""SELECT CAST(day AS VARCHAR) AS day, count(*) AS forecasts, round(avg(trigger), 6) AS mean_trigger, count(DISTINCT e.station) AS with_event FROM live l
 LEFT JOIN (SELECT DISTINCT station, day AS d FROM ev) e ON e.station = l.station AND e.d = l.day GROUP BY 1""", "live", "ev"))
def forecast_archive(spark, sf):
    from ..session import scratch_path
    from ..sources.sinks import append_forecast, outcomes
    o = Outlook(spark, sf)
    path = scratch_path(spark, "forecasts")
    append_forecast(o.live(), path, ISSUED, "v1")
    j = outcomes(spark.read.parquet(path), o.events().select("station", "day").distinct())
    return j.groupBy("day").agg(F.count(F.lit(1)).alias("forecasts"), r6(F.avg("trigger"), "mean_trigger"), F.sum("happened").alias("with_event")).select(txt("day"), "forecasts", "mean_trigger", "with_event")
