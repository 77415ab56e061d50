"""Evaluation, statistics, labels and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluate as E
from ..operators import labels as Lb
from ..operators import rain as R
from ..operators import series as Se
from ..operators import terrain as T
from ..operators.ranking import average_ranks, ecdf, percentiles
from ..session import reused
from . import q_terrain  # noqa: F401  (registers shared SQL)
from .fixtures import Tables
from .q_rain import r6, txt
from .registry import query
from .twins import register_cte, twin

AUC_EXPR = "(sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0e0) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)))"


def ranked(src: str, by: str = "", score: str = "score") -> str:
    p = f"PARTITION BY {by}" if by else ""
    pe = f"PARTITION BY {by}, {score}" if by else f"PARTITION BY {score}"
    return f"SELECT *, rank() OVER ({p} ORDER BY {score}) + (count(*) OVER ({pe}) - 1) / 2.0e0 AS r FROM {src} WHERE {score} IS NOT NULL"


def ap(by: str = "") -> str:
    p = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    return f"""SELECT {g}sum(pos / CAST(tot AS DOUBLE) * tp / seen) AS ap FROM (SELECT {g}score, pos, sum(pos) OVER ({p}) AS tot,
     sum(pos) OVER ({p} ORDER BY score DESC) AS tp, sum(n) OVER ({p} ORDER BY score DESC) AS seen
     FROM (SELECT {g}score, count(*) AS n, sum(label) AS pos FROM scores GROUP BY {g}score)) {'GROUP BY ' + by if by else ''}"""


@query("roc_auc", "M4", twin(f"""SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, round({AUC_EXPR}, 9) AS auc,
 round(1.96e0 * sqrt({AUC_EXPR} * (1 - {AUC_EXPR}) / sum(label)), 9) AS ci95 FROM rk""", "scores", extra={"rk": ranked("scores")}))
def roc_auc(spark, sf):
    a = E.auc(Tables(spark, sf).scores(), "score", "label")
    return a.select("n_pos", "n_neg", r6("auc", n=9), r6("ci95", n=9))


@query("average_precision", "M5", twin("SELECT round(ap, 9) AS average_precision FROM a", "scores", extra={"a": ap()}))
def average_precision(spark, sf):
    return E.average_precision(Tables(spark, sf).scores(), "score", "label").select(r6("average_precision", n=9))


@query("precision_at_top", "M6", twin("""SELECT CAST(greatest(1, floor(0.01e0 * count(*))) AS BIGINT) AS k,
 round(sum(CASE WHEN rn <= greatest(1, floor(0.01e0 * t)) THEN label ELSE 0 END) / greatest(1, floor(0.01e0 * count(*))), 9) AS precision
 FROM (SELECT *, count(*) OVER () AS t, row_number() OVER (ORDER BY score DESC, md5(id || '|0'), id) AS rn FROM scores) GROUP BY t""", "scores"))
def precision_at_top(spark, sf):
    return E.precision_at(Tables(spark, sf).scores(), "score", "label", ["id"]).select(F.col("k").cast("long"), r6("precision", n=9))


@query("cv_report", "M7", twin(f"""SELECT round(avg(auc), 9) AS mean_auc, round(stddev_pop(auc), 9) AS std_auc, round(avg(ap), 9) AS mean_ap, count(*) AS folds,
 round((SELECT {AUC_EXPR} FROM rk0), 9) AS pooled_auc FROM (SELECT fold, {AUC_EXPR} AS auc FROM rk GROUP BY fold) JOIN a USING (fold)""", "scores",
 extra={"rk": ranked("scores", "fold"), "rk0": ranked("scores"), "a": ap("fold")}))
def cv_report(spark, sf):
    c = E.cv_report(Tables(spark, sf).scores(), "score", "label", "fold")
    return c.select(r6("mean_auc", n=9), r6("std_auc", n=9), r6("mean_ap", n=9), "folds", r6("pooled_auc", n=9))


@query("fold_auc", "M4 M7", twin(f"SELECT fold, round({AUC_EXPR}, 9) AS auc FROM rk GROUP BY fold", "scores", extra={"rk": ranked("scores", "fold")}))
def fold_auc(spark, sf):
    return E.auc(Tables(spark, sf).scores(), "score", "label", ["fold"]).select("fold", r6("auc", n=9))


register_cte("classed", ("labelled",), """SELECT cell_id, label, s, CAST(CASE WHEN s IS NULL THEN 0 ELSE 1 + (s >= 0.05e0)::INT + (s >= 0.15e0)::INT + (s >= 0.35e0)::INT + (s >= 0.60e0)::INT END AS INT) AS cls
  FROM (SELECT cell_id, label, CASE WHEN lc NOT IN (70, 80, 100) AND slope > 10 THEN slope / 45.0e0 END AS s FROM labelled)""")


def susceptible(t: Tables):
    """Cells with a susceptibility inside the modelling domain, its class and the label."""
    from ..config import SUSCEPTIBILITY_BREAKS
    from ..functions.classify import classify
    ok = ~F.col("lc").isin(70, 80, 100) & (F.col("slope") > 10)
    c = t.labelled().withColumn("s", F.when(ok, F.col("slope") / 45.0))
    return c.withColumn("cls", classify(F.col("s"), SUSCEPTIBILITY_BREAKS))


@query("success_rate", "M8", twin("""SELECT cls, round(n / sum(n) OVER (), 6) AS area_share, round(k / sum(k) OVER (), 6) AS slide_share, round((k / sum(k) OVER ()) / (n / sum(n) OVER ()), 6) AS lift
 FROM (SELECT cls, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS k FROM classed WHERE cls > 0 GROUP BY cls)""", "classed"))
def success_rate(spark, sf):
    s = E.success_rate(susceptible(Tables(spark, sf)), "cls", "label")
    return s.select("cls", r6("area_share"), r6("slide_share"), r6("lift"))


@query("point_inventory_check", "M9", twin("""SELECT count(*) AS n, round(avg((cls >= 4)::INT), 6) AS share_high, round(avg((cls >= 4)::INT) / (SELECT avg((cls >= 4)::INT) FROM classed WHERE cls > 0), 6) AS lift,
 round(quantile_cont(s, 0.5), 6) AS median_score FROM flags JOIN classed USING (cell_id) WHERE cls > 0""", "classed", "flags"))
def point_inventory_check(spark, sf):
    t = Tables(spark, sf)
    p = E.point_check(t.flags().select("cell_id"), susceptible(t).select("cell_id", "s", "cls"), "s", "cls")
    return p.select("n", r6("share_high"), r6("lift"), r6("median_score"))


EVT = {"evt": "SELECT event_id, accuracy, size, trigger FROM ev JOIN trig USING (station, day)"}
CUTS = (0.50, 0.75, 0.90, 0.95, 0.99)


@query("operating_points", "M10 I23", twin("""SELECT t AS threshold, round((SELECT avg((trigger >= t)::INT) FROM trig), 6) AS alert_share, round((SELECT avg((trigger >= t)::INT) FROM evt), 6) AS capture,
 round(CASE WHEN (SELECT avg((trigger >= t)::INT) FROM trig) > 0 THEN (SELECT avg((trigger >= t)::INT) FROM evt) / (SELECT avg((trigger >= t)::INT) FROM trig) ELSE 0 END, 6) AS lift
 FROM (SELECT unnest([0.5e0, 0.75e0, 0.9e0, 0.95e0, 0.99e0]) AS t)""", "trig", "ev", extra=EVT))
def operating_points(spark, sf):
    t = Tables(spark, sf)
    trig = reused(Se.season_trigger(t.readings()))
    a = A.alerts_and_capture(trig, t.events().join(trig, ["station", "day"]), CUTS)
    return a.select("threshold", r6("alert_share"), r6("capture"), r6("lift"))


@query("percentile_operating_points", "M11", twin("""SELECT p AS percentile, round(t, 6) AS threshold, round((SELECT avg((trigger >= t)::INT) FROM trig), 6) AS alert, round((SELECT avg((trigger >= t)::INT) FROM evt), 6) AS capture
 FROM (SELECT 0.75e0 AS p, quantile_cont(trigger, 0.75) AS t FROM trig UNION ALL SELECT 0.9e0, quantile_cont(trigger, 0.9) FROM trig UNION ALL SELECT 0.95e0, quantile_cont(trigger, 0.95) FROM trig)""", "trig", "ev", extra=EVT))
def percentile_operating_points(spark, sf):
    t = Tables(spark, sf)
    trig = reused(Se.season_trigger(t.readings()))
    a = E.percentile_operating_points(t.events().join(trig, ["station", "day"]), trig, "trigger", [0.75, 0.9, 0.95])
    return a.select("percentile", r6("threshold"), r6("alert"), r6("capture"))


@query("auc_by_accuracy_band", "M12", twin(f"""SELECT accuracy, CAST(sum(label) AS BIGINT) AS n_pos, round({AUC_EXPR}, 9) AS auc FROM rk GROUP BY 1 HAVING sum(label) >= 3""", "trig", "ev", extra=dict(EVT,
 allr="SELECT accuracy, 1 AS label, trigger FROM evt UNION ALL SELECT b.a, 0, trigger FROM trig, (SELECT unnest(['exact', '1km', '5km']) AS a) b", rk=ranked("allr", "accuracy", "trigger"))))
def auc_by_accuracy_band(spark, sf):
    t = Tables(spark, sf)
    trig = reused(Se.season_trigger(t.readings()))
    a = E.auc_by_band(t.events().join(trig, ["station", "day"]), trig, "trigger", "accuracy", ["exact", "1km", "5km"])
    return a.select("accuracy", "n_pos", r6("auc", n=9))


@query("compare_models", "M13",
 f"""WITH m AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity / 50.0e0 AS w, l_discount * 10 AS h FROM lineitem),
 l AS (SELECT label, 'where' AS model, w AS score FROM m UNION ALL SELECT label, 'when', h + 0.0e0 FROM m UNION ALL SELECT label, 'product', w * h + 0.0e0 FROM m),
 rk AS ({ranked("l", "model")}) SELECT model, round({AUC_EXPR}, 9) AS auc FROM rk GROUP BY 1""")
def compare_models(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    m = li.select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") / 50.0).alias("where"), (F.col("l_discount") * 10 + 0.0).alias("when"))
    m = m.withColumn("product", F.col("where") * F.col("when") + 0.0)
    return E.compare_models(m, ["where", "when", "product"], "label").select("model", r6("auc", n=9))


@query("channel_auc", "M14", f"""WITH l AS (SELECT l_linenumber AS scene, 'vv' AS channel, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity AS score FROM lineitem UNION ALL
  SELECT l_linenumber, 'vh', CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_extendedprice FROM lineitem UNION ALL SELECT l_linenumber, 'ratio', CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_extendedprice / greatest(l_quantity, 0.000001e0) FROM lineitem),
 rk AS ({ranked("l", "scene, channel")}), a AS (SELECT scene, channel, {AUC_EXPR} AS auc FROM rk GROUP BY 1, 2)
 SELECT channel, round(avg(greatest(auc, 1 - auc)), 9) AS mean_auc, count(auc) AS scenes FROM a GROUP BY 1""")
def channel_auc(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    x = li.select(F.col("l_linenumber").alias("scene"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").alias("vv"),
                  F.col("l_extendedprice").alias("vh"), (F.col("l_extendedprice") / F.greatest("l_quantity", F.lit(1e-6))).alias("ratio"))
    return E.channel_auc(x, "scene", ["vv", "vh", "ratio"], "label").select("channel", r6("mean_auc", n=9), "scenes")


@query("event_duration_curve", "M15", None)
def event_duration_curve(spark, sf):
    t = Tables(spark, sf)
    ev, obs = t.events().select("station", "day"), t.readings()
    # only days of storms meet the events, once; every other event at a known station within the calendar fell on a dry day
    storms = t.storms().where("storm_dur > 0").select("station", "day", "storm_dur", "storm_rain")
    wet = reused(storms.join(ev, ["station", "day"]).select((F.col("storm_dur") * 24.0).alias("hours"), "storm_rain"))
    fit = E.ed_curve(wet, "hours", "storm_rain")
    span = obs.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi")).alias("s")).scalar()
    known = ev.join(obs.select("station").distinct(), "station", "left_semi").withColumn("_s", span).where(F.col("day").between(F.col("_s.lo"), F.col("_s.hi")))
    n = known.agg(F.count(F.lit(1)).alias("all")).withColumn("wet", wet.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("dry", F.col("all") - F.col("wet"))
    return n.select("wet", "dry", F.lit(fit["a"]).alias("a"), F.lit(fit["b"]).alias("b"), F.lit(fit["share_above"]).alias("share_above"))


@query("event_duration_optimum", "M15", twin("""SELECT round(min(loss), 6) AS loss, true AS certified FROM (SELECT l.a, l.b, sum(m * CASE WHEN y - a - b * x >= 0 THEN 0.1e0 * (y - a - b * x) ELSE -0.9e0 * (y - a - b * x) END) AS loss
 FROM ed, (SELECT DISTINCT u.y - (v.y - u.y) / (v.x - u.x) * u.x AS a, (v.y - u.y) / (v.x - u.x) AS b FROM ed u JOIN ed v ON u.x < v.x) l GROUP BY 1, 2)""", "rain", "ev", extra={
 "isl": "SELECT *, sum(CASE WHEN mm > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY day) AS g FROM rain",
 "storm": """SELECT station, day, count(*) FILTER (WHERE mm > 1) OVER w AS dur, sum(mm) FILTER (WHERE mm > 1) OVER w AS total, mm FROM isl WINDOW w AS (PARTITION BY station, g ORDER BY day)""",
 "ed": "SELECT log10(dur * 24.0e0) AS x, log10(total) AS y, CAST(count(*) AS DOUBLE) AS m FROM storm JOIN ev USING (station, day) WHERE mm > 1 GROUP BY 1, 2"}))
def event_duration_optimum(spark, sf):
    """The twin tries the lines through all pairs of events."""
    t = Tables(spark, sf)
    s = Se.rain_series(t.readings(), windows=(1,), peak=None, wet_window=None, decay=None).join(t.events().select("station", "day"), ["station", "day"])
    fit = E.ed_optimum(s.withColumn("hours", F.col("storm_dur") * 24.0), "hours", "storm_rain")
    return s.agg(F.round(F.lit(fit["loss"]), 6).alias("loss"), F.lit(fit["certified"]).alias("certified"))


@query("correlations", "M16", "SELECT round(corr(l_quantity, l_extendedprice), 9) AS plain, round(corr(ln(l_quantity), ln(l_extendedprice)), 9) AS loglog FROM lineitem")
def correlations(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    return li.agg(r6(F.corr("l_quantity", "l_extendedprice"), "plain", 9), r6(F.corr(F.ln("l_quantity"), F.ln("l_extendedprice")), "loglog", 9))


@query("spearman", "M17", """SELECT round(corr(rx, ry), 9) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0 AS rx,
 rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0e0 AS ry FROM lineitem)""")
def spearman(spark, sf):
    return E.spearman(Tables(spark, sf).raw("lineitem"), "l_quantity", "l_extendedprice").select(r6("rho", n=9), "n")


@query("kruskal_wallis", "M18", """WITH r AS (SELECT l_linenumber AS g, l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0 AS r FROM lineitem),
 t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY v)), s AS (SELECT sum(q) AS q, CAST(sum(m) AS DOUBLE) AS n, count(*) AS groups FROM (SELECT sum(r) * sum(r) / count(*) AS q, count(*) AS m FROM r GROUP BY g))
 SELECT round((12.0e0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS h, groups, CAST(n AS BIGINT) AS n FROM s, t""")
def kruskal_wallis(spark, sf):
    return E.kruskal(Tables(spark, sf).raw("lineitem"), "l_linenumber", "l_quantity").select(r6("h", n=5), "groups", "n")


PERM = dict(EVT, rr="""SELECT event_id, rank() OVER (ORDER BY trigger) + (count(*) OVER (PARTITION BY trigger) - 1) / 2.0e0 AS rx, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0e0 AS ry FROM evt""",
 lft="SELECT rx, row_number() OVER (ORDER BY md5(event_id || '|x7'), event_id) AS pos FROM rr",
 rgt="SELECT perm, ry, row_number() OVER (PARTITION BY perm ORDER BY md5(event_id || '|' || perm || '|7'), event_id) AS pos FROM rr, (SELECT unnest(range(1, 2001)) AS perm)",
 nul="SELECT perm, corr(rx, ry) AS rho FROM lft JOIN rgt USING (pos) GROUP BY perm")


@query("permutation_null", "M19", twin("""SELECT round((SELECT abs(corr(rx, ry)) FROM rr), 9) AS observed, round(avg((abs(rho) >= (SELECT abs(corr(rx, ry)) FROM rr))::INT), 6) AS share_beyond,
 round(quantile_cont(abs(rho), 0.95), 9) AS null_p95, count(*) AS permutations FROM nul""", "trig", "ev", extra=PERM))
def permutation_null(spark, sf):
    t = Tables(spark, sf)
    e = t.events().join(Se.season_trigger(t.readings()), ["station", "day"])
    p = E.permutation_null(e, ["event_id"], "trigger", "size", 2000, 7)
    return p.select(r6("observed", n=9), r6("share_beyond"), r6("null_p95", n=9), "permutations")


@query("group_variance_share", "M20", "SELECT round(1 - avg(v) / (SELECT var_pop(log10(l_extendedprice)) FROM lineitem), 9) AS explained FROM (SELECT var_samp(log10(l_extendedprice)) AS v FROM lineitem GROUP BY l_suppkey)")
def group_variance_share(spark, sf):
    li = Tables(spark, sf).raw("lineitem").withColumn("la", F.log10("l_extendedprice"))
    return E.group_variance_share(li, "l_suppkey", "la").select(r6("explained", n=9))


@query("event_check", "M22 M23", twin("""SELECT round(100.0e0 * avg((b.r7 < m)::INT), 6) AS percentile, m AS event_median, quantile_cont(b.r7, 0.5) AS base_median,
 CASE WHEN 100.0e0 * avg((b.r7 < m)::INT) >= 75 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT r.* FROM rolled r SEMI JOIN (SELECT DISTINCT station, month(day) AS mo FROM ev) k ON k.station = r.station AND k.mo = month(r.day)) b,
 (SELECT quantile_cont(r7, 0.5) AS m FROM rolled JOIN ev USING (station, day)) WHERE b.r7 IS NOT NULL GROUP BY m""", "rolled", "ev"))
def event_check(spark, sf):
    t = Tables(spark, sf)
    return E.event_check(t.rolled(), t.events(), "r7").select(r6("percentile"), "event_median", "base_median", "verdict")


@query("inventory_reappearance", "M26", twin("""SELECT round(avg((sqrt(d2) <= 2)::INT), 6) AS share_within, count(*) AS n FROM near WHERE cell_id IN (SELECT cell_id FROM sources)""", "near", "sources"))
def inventory_reappearance(spark, sf):
    t = Tables(spark, sf)
    d = T.nearest_flag(t.sources().select("cell_id", "row", "col").distinct(), t.flags())
    return E.share_within(d, 2.0).select(r6("share_within"), "n")


@query("inventory_distances", "M26 I3", twin("SELECT round(quantile_cont(sqrt(d2), 0.5), 6) AS p50, round(quantile_cont(sqrt(d2), 0.9), 6) AS p90, round(quantile_cont(sqrt(d2), 0.99), 6) AS p99 FROM near WHERE cell_id IN (SELECT cell_id FROM sources)", "near", "sources"))
def inventory_distances(spark, sf):
    t = Tables(spark, sf)
    d = T.nearest_flag(t.sources().select("cell_id", "row", "col").distinct(), t.flags())
    return percentiles(d, "dist", [0.5, 0.9, 0.99]).select(r6("p0", "p50"), r6("p1", "p90"), r6("p2", "p99"))


@query("worst_year_agreement", "M27", twin("""SELECT round(avg((a.y = b.y)::INT), 6) AS agreement, round(avg(1.0e0 / b.n), 6) AS chance, count(*) AS stations FROM
 (SELECT station, arg_min(y, struct_pack(k := -k, y := y)) AS y FROM (SELECT station, year(day) AS y, count(*) AS k FROM ev GROUP BY 1, 2) GROUP BY 1) a JOIN
 (SELECT station, arg_min(y, struct_pack(k := -k, y := y)) AS y, count(*) AS n FROM (SELECT station, year(day) AS y, sum(mm) AS k FROM rain GROUP BY 1, 2) GROUP BY 1) b USING (station)""", "ev", "rain"))
def worst_year_agreement(spark, sf):
    t = Tables(spark, sf)
    return E.worst_year_agreement(t.events(), t.rain()).select(r6("agreement"), r6("chance"), "stations")


@query("proximity_enrichment", "M28", twin("""SELECT round(avg((sqrt(d2) <= 2.5 AND cell_id IN (SELECT cell_id FROM sources))::INT) / avg((cell_id IN (SELECT cell_id FROM sources))::INT), 6) AS events_near,
 round(avg((sqrt(d2) <= 2.5)::INT), 6) AS land_near FROM near""", "near", "sources"))
def proximity_enrichment(spark, sf):
    t = Tables(spark, sf)
    d = T.nearest_flag(t.cells(), t.flags()).join(t.labelled().select("cell_id", "label"), "cell_id")
    near = F.col("dist") <= 2.5
    return d.agg(r6(F.count_if(near & (F.col("label") == 1)) / F.sum("label"), "events_near"), r6(F.avg(near.cast("double")), "land_near"))


@query("detection_scores", "M29", twin("SELECT round(count(*) FILTER (WHERE score >= 0.8e0 AND label = 1) / CAST(sum(label) AS DOUBLE), 6) AS pod, round(count(*) FILTER (WHERE score >= 0.8e0 AND label = 0) / CAST(count(*) FILTER (WHERE score >= 0.8e0) AS DOUBLE), 6) AS far FROM scores", "scores"))
def detection_scores(spark, sf):
    d = E.detection(Tables(spark, sf).scores(), F.col("score") >= 0.8, F.col("label") == 1, True)
    return d.select(r6("pod"), r6("far"))


@query("detection_presence_only", "M29", twin("SELECT round(count(*) FILTER (WHERE score >= 0.8e0 AND label = 1) / CAST(sum(label) AS DOUBLE), 6) AS pod, CAST(NULL AS DOUBLE) AS far FROM scores", "scores"))
def detection_presence_only(spark, sf):
    d = E.detection(Tables(spark, sf).scores(), F.col("score") >= 0.8, F.col("label") == 1, False)
    return d.select(r6("pod"), "far")


BREAKS = "[" + ", ".join(f"{i / 100}" for i in range(101)) + "]"


@query("temporal_holdout", "M31", twin(f"""SELECT round({AUC_EXPR}, 9) AS auc FROM rk""", "rolled", "ev", extra={
 "c": f"SELECT station, quantile_cont(r3, {BREAKS}) AS b3, quantile_cont(r7, {BREAKS}) AS b7 FROM rolled WHERE month(day) BETWEEN 5 AND 10 AND year(day) < 2000 GROUP BY 1",
 "held": """SELECT station, day, (least(len(list_filter(b3, lambda b: b < r3)) / 100.0e0, 1.0e0) + least(len(list_filter(b7, lambda b: b < r7)) / 100.0e0, 1.0e0)) / 2.0e0 AS score FROM rolled JOIN c USING (station) WHERE year(day) >= 2000 AND month(day) BETWEEN 5 AND 10""",
 "h": "SELECT t.station, CASE WHEN e.station IS NULL THEN 0 ELSE 1 END AS label, score FROM held t LEFT JOIN (SELECT DISTINCT station, day FROM ev) e ON e.station = t.station AND e.day = t.day", "rk": ranked("h")}))
def temporal_holdout(spark, sf):
    t = Tables(spark, sf)
    trig = R.holdout_trigger(t.rolled(), 2000)
    e = t.events().select("station", "day").distinct().withColumn("label", F.lit(1))
    return E.auc(trig.join(e, ["station", "day"], "left").fillna(0, ["label"]), "trigger", "label").select(r6("auc", n=9))


@query("class_agreement", "M32", twin("""SELECT round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, n FROM (SELECT avg((a = b)::INT) AS po, count(*) AS n FROM k),
 (SELECT sum(x.c * y.c) / pow((SELECT count(*) FROM k), 2) AS pe FROM (SELECT a, CAST(count(*) AS DOUBLE) AS c FROM k GROUP BY 1) x JOIN (SELECT b, CAST(count(*) AS DOUBLE) AS c FROM k GROUP BY 1) y ON x.a = y.b)""", "classed", "cells",
 extra={"k": "SELECT c.cls AS a, CAST(cells.lc // 20 AS INT) AS b FROM classed c JOIN cells USING (cell_id)"}))
def class_agreement(spark, sf):
    c = susceptible(Tables(spark, sf)).select("cls", F.floor(F.col("lc") / 20).cast("int").alias("b"))
    return E.class_agreement(c, "cls", "b").select(r6("agreement"), r6("kappa"), "n")


@query("average_ranks", "J3", "SELECT DISTINCT l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0 AS avg_rank FROM lineitem")
def avg_ranks(spark, sf):
    return average_ranks(Tables(spark, sf).raw("lineitem"), "l_quantity").select(F.col("l_quantity").alias("v"), "avg_rank")


@query("empirical_cdf", "J8", "SELECT DISTINCT l_extendedprice AS v, round(cume_dist() OVER (ORDER BY l_extendedprice), 9) AS share FROM lineitem")
def empirical_cdf(spark, sf):
    return ecdf(Tables(spark, sf).raw("lineitem"), "l_extendedprice").select(F.col("l_extendedprice").alias("v"), r6("share", n=9))


# --- labels, folds, samples ---------------------------------------------------------


@query("label_agreement", "L1", twin("SELECT n_sources, count(*) AS cells FROM (SELECT cell_id, CAST(count(DISTINCT bit) AS INT) AS n_sources FROM sources GROUP BY 1) GROUP BY 1", "sources"))
def label_agreement(spark, sf):
    from ..operators.spatial import source_bitmask
    return Lb.agreement_table(source_bitmask(Tables(spark, sf).sources()))


BLK = {"blk": "SELECT CAST(row // 6 AS BIGINT) * 100000 + col // 6 AS block, CAST(row // 6 AS INT) AS br, CAST(col // 6 AS INT) AS bc, count(*) AS n_cells FROM cells GROUP BY 1, 2, 3",
 "kept": "SELECT *, CAST((row_number() OVER (ORDER BY md5(block || '|42'), block) - 1) % 5 AS INT) AS fold FROM blk WHERE n_cells >= 30",
 "folds": """SELECT block, n_cells, fold, 0 AS is_sliver FROM kept UNION ALL SELECT b.block, b.n_cells, arg_min(k.fold, struct_pack(d := pow(b.br - k.br, 2) + pow(b.bc - k.bc, 2), k := k.block)), 1
   FROM blk b, kept k WHERE b.n_cells < 30 GROUP BY 1, 2"""}


def blocks_of(t: Tables):
    return t.cells().groupBy(F.floor(F.col("row") / 6).cast("int").alias("block_row"), F.floor(F.col("col") / 6).cast("int").alias("block_col")).agg(
        F.count(F.lit(1)).alias("n_cells")).withColumn("block", F.col("block_row").cast("long") * 100000 + F.col("block_col"))


@query("spatial_folds", "L2 L3", twin("SELECT * FROM folds", "cells", extra=BLK))
def spatial_folds(spark, sf):
    return Lb.make_folds(blocks_of(Tables(spark, sf)), 30, 42)


@query("fold_report", "L4", twin("SELECT fold, count(*) AS blocks, CAST(sum(n_cells) AS BIGINT) AS cells, CAST(sum(is_sliver) AS BIGINT) AS slivers FROM folds GROUP BY 1", "cells", extra=BLK))
def fold_report(spark, sf):
    return Lb.fold_report(Lb.make_folds(blocks_of(Tables(spark, sf)), 30, 42))


@query("attach_fold", "C12", twin("SELECT fold, count(*) AS cells FROM folds JOIN (SELECT CAST(row // 6 AS BIGINT) * 100000 + col // 6 AS block FROM cells) USING (block) GROUP BY 1", "cells", extra=BLK))
def attach_fold(spark, sf):
    from ..functions.lattice import block_id
    from ..operators.lattice import attach_fold as af
    t = Tables(spark, sf)
    c = t.cells().withColumn("block", block_id(F.col("row"), F.col("col"), 6).cast("long"))
    return af(c, Lb.make_folds(blocks_of(t), 30, 42)).groupBy("fold").agg(F.count(F.lit(1)).alias("cells"))


SMP = {"pool": "SELECT cell_id, label, CAST(col % 5 AS INT) AS fold FROM labelled", "neg": """SELECT cell_id, fold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5(cell_id || '|3'), cell_id) AS rn FROM pool WHERE label = 0)
   JOIN (SELECT fold, count(*) * 5 AS quota FROM pool WHERE label = 1 GROUP BY 1) USING (fold) WHERE rn <= quota"""}


@query("sample_negatives", "L5", twin("SELECT cell_id, fold FROM neg", "labelled", extra=SMP))
def sample_negatives(spark, sf):
    c = Tables(spark, sf).labelled().withColumn("fold", F.pmod(F.col("col"), F.lit(5)))
    return Lb.sample_negatives(c.where("label = 0"), c.where("label = 1"), ["cell_id"], 5, 3).select("cell_id", "fold")


@query("training_sample", "L6 H1", twin("SELECT cell_id, label, elev, slope, lc FROM (SELECT cell_id, 0 AS label FROM neg UNION ALL SELECT cell_id, 1 FROM pool WHERE label = 1) JOIN cells USING (cell_id)", "labelled", "cells", extra=SMP))
def training_sample(spark, sf):
    c = Tables(spark, sf).labelled().withColumn("fold", F.pmod(F.col("col"), F.lit(5)))
    pos = c.where("label = 1")
    neg = Lb.sample_negatives(c.where("label = 0"), pos, ["cell_id"], 5, 3)
    s = pos.select("cell_id", "label").unionByName(neg.select("cell_id", "label"))
    return Lb.attach_features(s, Tables(spark, sf).cells(), ["elev", "slope", "lc"])


@query("cap_per_class", "L7", twin("SELECT cell_id, lith FROM (SELECT *, row_number() OVER (PARTITION BY lith ORDER BY md5(cell_id || '|1'), cell_id) AS rn FROM cells) WHERE rn <= 50", "cells"))
def cap_per_class(spark, sf):
    return Lb.cap_per_class(Tables(spark, sf).cells(), "lith", 50, ["cell_id"], 1).select("cell_id", "lith")


DRAW = {"c": "SELECT cell_id, row_number() OVER (ORDER BY md5(cell_id || '|c5'), cell_id) AS ci FROM cells", "d": "SELECT day, row_number() OVER (ORDER BY md5(CAST(day AS VARCHAR) || '|d5'), day) AS di FROM cal WHERE month(day) BETWEEN 5 AND 10",
 "k": """SELECT id, CAST(floor(CAST('0x' || substr(md5(id || '|ci5'), 1, 8) AS BIGINT) / 4294967296.0e0 * (SELECT count(*) FROM c)) + 1 AS BIGINT) AS ci,
   CAST(floor(CAST('0x' || substr(md5(id || '|di5'), 1, 8) AS BIGINT) / 4294967296.0e0 * (SELECT count(*) FROM d)) + 1 AS BIGINT) AS di FROM (SELECT unnest(range(2000)) AS id)"""}


@query("background_draw", "L8", twin("SELECT id, cell_id, CAST(day AS VARCHAR) AS day FROM k JOIN c USING (ci) JOIN d USING (di)", "cells", "cal", extra=DRAW))
def background_draw(spark, sf):
    t = Tables(spark, sf)
    days = R.calendar(t.readings()).where(F.month("day").between(5, 10))
    return Lb.background_draw(t.cells().select("cell_id"), days, 2000, 5).select("id", "cell_id", txt("day"))


MC = {"t": "SELECT cell_id, CASE WHEN label = 1 THEN 'slide' ELSE 'control' END AS role, CAST(floor(slope / 10) * 10 AS INT) AS band FROM labelled WHERE slope >= 10 AND slope < 70",
 "q": "SELECT band, least(a, b) AS take FROM (SELECT band, count(*) FILTER (WHERE role = 'slide') AS a, count(*) FILTER (WHERE role = 'control') AS b FROM t GROUP BY 1) WHERE a >= 20 AND b >= 20"}


@query("matched_controls", "L9", twin("SELECT cell_id, role, band FROM (SELECT *, row_number() OVER (PARTITION BY band, role ORDER BY md5(cell_id || '|0'), cell_id) AS rn FROM t) JOIN q USING (band) WHERE rn <= take", "labelled", extra=MC))
def matched_controls(spark, sf):
    c = Tables(spark, sf).labelled()
    return Lb.matched_controls(c, F.col("label") == 1, F.col("label") == 0, "slope", ["cell_id"], floor_rows=20).select("cell_id", "role", "band")


@query("dealt_folds", "L10", twin("SELECT k AS block, CAST((row_number() OVER (ORDER BY md5(k || '|9'), k) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT (row // 8) || '_' || (col // 8) AS k FROM cells)", "cells"))
def dealt_folds(spark, sf):
    c = Tables(spark, sf).cells()
    k = c.select(F.concat_ws("_", F.floor(F.col("row") / 8), F.floor(F.col("col") / 8)).alias("block"))
    return Lb.dealt_folds(k, "block", 9)


@query("naive_sample_overlap", "L11", twin("""SELECT count(*) AS n, round(avg((sqrt(d2) * 100 <= 500)::INT), 6) AS share_near FROM (SELECT cell_id FROM (SELECT cell_id, row_number() OVER (PARTITION BY fold ORDER BY md5(cell_id || '|3'), cell_id) AS rn, fold FROM pool WHERE label = 0)
   JOIN (SELECT fold, count(*) * 5 AS quota FROM pool WHERE label = 1 GROUP BY 1) USING (fold) WHERE rn <= quota) JOIN near USING (cell_id)""", "labelled", "near", extra={"pool": SMP["pool"]}))
def naive_sample_overlap(spark, sf):
    t = Tables(spark, sf)
    c = t.labelled().withColumn("fold", F.pmod(F.col("col"), F.lit(5)))
    naive = Lb.sample_negatives(c.where("label = 0"), c.where("label = 1"), ["cell_id"], 5, 3)
    d = T.nearest_flag(t.cells(), t.flags()).withColumn("dist_m", F.col("dist") * 100)
    return Lb.naive_sample_overlap(naive.select("cell_id"), d, 500.0).select("n", r6("share_near"))


@query("domain_ablation_auc", "L11 M24", twin(f"SELECT 'all' AS domain, round({AUC_EXPR}, 9) AS auc FROM ra UNION ALL SELECT 'constrained', round({AUC_EXPR}, 9) FROM rb", "labelled", extra={
 "a": "SELECT label, slope AS score FROM labelled", "b": "SELECT label, slope AS score FROM labelled WHERE lc NOT IN (70, 80, 100) AND slope > 10", "ra": ranked("a"), "rb": ranked("b")}))
def domain_ablation_auc(spark, sf):
    from ..operators.lattice import domain_filter
    c = Tables(spark, sf).labelled()
    a = E.auc(c, "slope", "label").select(F.lit("all").alias("domain"), r6("auc", n=9))
    return a.unionByName(E.auc(domain_filter(c), "slope", "label").select(F.lit("constrained").alias("domain"), r6("auc", n=9)))
