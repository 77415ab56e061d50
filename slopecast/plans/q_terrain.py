"""Terrain and distance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terrain as T
from .fixtures import Tables
from .q_rain import r6
from .registry import query
from .twins import register_cte, twin


def diff(c: str, before: str, after: str) -> str:
    return (f"CASE WHEN {before} IS NOT NULL AND {after} IS NOT NULL THEN ({after} - {before}) / 200.0e0 "
            f"WHEN {after} IS NOT NULL THEN ({after} - {c}) / 100.0e0 WHEN {before} IS NOT NULL THEN ({c} - {before}) / 100.0e0 END")


def around(src: str, cols: list[str]) -> str:
    picks = ", ".join(f"{t}.{c} AS {c}_{t}" for c in cols for t in ("w", "e", "n", "s"))
    return (f"SELECT c.*, {picks} FROM {src} c LEFT JOIN {src} w ON w.row = c.row AND w.col = c.col - 1 "
            f"LEFT JOIN {src} e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN {src} n ON n.row = c.row - 1 AND n.col = c.col "
            f"LEFT JOIN {src} s ON s.row = c.row + 1 AND s.col = c.col")


register_cte("nb", ("cells",), around("cells", ["elev"]))
register_cte("pq", ("nb",), f"SELECT cell_id, row, col, lc, elev, {diff('elev', 'elev_w', 'elev_e')} AS p, -({diff('elev', 'elev_n', 'elev_s')}) AS q FROM nb")
register_cte("surf", ("pq",), "SELECT *, degrees(atan(sqrt(p * p + q * q))) AS slope_deg, atan2(-p, q) AS aspect FROM pq")


@query("surface_slope_aspect", "D1 D2 D3", twin("""SELECT cell_id, round(p, 6) + 0.0e0 AS p, round(q, 6) + 0.0e0 AS q, round(slope_deg, 6) AS slope_deg,
 round(cos(aspect), 6) + 0.0e0 AS northness, round(sin(aspect), 6) + 0.0e0 AS eastness FROM surf""", "surf"))
def surface_slope_aspect(spark, sf):
    s = T.surface(Tables(spark, sf).cells())
    return s.select("cell_id", r6("p"), r6("q"), r6("slope_deg"), r6("northness"), r6("eastness"))


register_cte("pqn", ("pq",), around("pq", ["p", "q"]))
register_cte("curv", ("pqn",), f"""SELECT cell_id, p, q, {diff('p', 'p_w', 'p_e')} AS r, -({diff('p', 'p_n', 'p_s')}) AS t, {diff('q', 'q_w', 'q_e')} AS s FROM pqn""")


@query("surface_curvature", "D4", twin("""SELECT cell_id,
 round(CASE WHEN p*p+q*q < 0.0001e0 THEN 0.0e0 ELSE least(0.5e0, greatest(-0.5e0, -(r*p*p + 2*s*p*q + t*q*q) / ((p*p+q*q) * pow(1 + (p*p+q*q), 1.5e0)))) END, 6) + 0.0e0 AS profile_curv,
 round(CASE WHEN p*p+q*q < 0.0001e0 THEN 0.0e0 ELSE least(0.5e0, greatest(-0.5e0, -(r*q*q - 2*s*p*q + t*p*p) / pow(p*p+q*q, 1.5e0))) END, 6) + 0.0e0 AS plan_curv FROM curv""", "curv"))
def surface_curvature(spark, sf):
    c = T.curvature(Tables(spark, sf).cells())
    return c.select("cell_id", r6("profile_curv"), r6("plan_curv"))


register_cte("flow", ("cells",), """SELECT c.cell_id, c.row, c.col, c.elev, f.code AS flow_code, f.down, f.drop FROM cells c LEFT JOIN (
  SELECT * FROM (SELECT a.cell_id, b.cell_id AS down, o.code, (a.elev - b.elev) / o.run AS drop,
   row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.elev - b.elev) / o.run DESC, o.code) AS k
   FROM cells a JOIN (VALUES (0,1,1,100.0e0),(1,1,2,100.0e0*sqrt(2.0e0)),(1,0,4,100.0e0),(1,-1,8,100.0e0*sqrt(2.0e0)),(0,-1,16,100.0e0),(-1,-1,32,100.0e0*sqrt(2.0e0)),(-1,0,64,100.0e0),(-1,1,128,100.0e0*sqrt(2.0e0))) o(dr, dc, code, run) ON true
   JOIN cells b ON b.row = a.row + o.dr AND b.col = a.col + o.dc WHERE a.elev > b.elev) WHERE k = 1) f ON f.cell_id = c.cell_id""")


@query("flow_direction", "D6 H8", twin("SELECT cell_id, flow_code, down, round(drop, 6) AS drop FROM flow", "flow"))
def flow_direction(spark, sf):
    return T.flow_direction(Tables(spark, sf).cells()).select("cell_id", "flow_code", "down", r6("drop"))


ACC = {"up(cell_id, tgt)": """SELECT cell_id, down FROM flow WHERE down IS NOT NULL UNION ALL SELECT u.cell_id, f.down FROM up u JOIN flow f ON f.cell_id = u.tgt WHERE f.down IS NOT NULL""",
       "accs": "SELECT f.cell_id, coalesce(n, 0) AS acc FROM flow f LEFT JOIN (SELECT tgt, count(*) AS n FROM up GROUP BY 1) a ON a.tgt = f.cell_id"}


@query("flow_accumulation", "D7", twin("SELECT cell_id, acc FROM accs", "flow", recursive=True, extra=ACC))
def flow_accumulation(spark, sf):
    return T.flow_accumulation(T.flow_direction(Tables(spark, sf).cells()))


@query("topographic_wetness", "D8", twin("""SELECT cell_id, round(ln((acc + 1) * 100.0e0 / tan(radians(greatest(slope_deg, 0.1e0)))), 6) AS twi
 FROM accs JOIN surf USING (cell_id)""", "flow", "surf", recursive=True, extra=ACC))
def topographic_wetness(spark, sf):
    c = Tables(spark, sf).cells()
    acc = T.flow_accumulation(T.flow_direction(c))
    j = T.surface(c).select("cell_id", "slope_deg").join(acc, "cell_id")
    return j.select("cell_id", r6(T.wetness(F.col("acc"), F.col("slope_deg")), "twi"))


register_cte("near", ("cells", "flags"), """SELECT c.cell_id, min(pow(c.row - f.row, 2) + pow(c.col - f.col, 2)) AS d2,
  arg_min(f.row, struct_pack(d := pow(c.row - f.row, 2) + pow(c.col - f.col, 2), r := f.row, c := f.col)) AS src_row,
  arg_min(f.col, struct_pack(d := pow(c.row - f.row, 2) + pow(c.col - f.col, 2), r := f.row, c := f.col)) AS src_col FROM cells c, flags f GROUP BY 1""")


@query("distance_to_flag", "D9", twin("SELECT cell_id, round(sqrt(d2) * 100.0e0, 6) AS dist_m FROM near", "near"))
def distance_to_flag(spark, sf):
    t = Tables(spark, sf)
    return T.nearest_flag(t.cells(), t.flags()).select("cell_id", r6(F.col("dist") * 100.0, "dist_m"))


@query("nearest_flag_source", "D10", twin("SELECT cell_id, src_row, src_col FROM near", "near"))
def nearest_flag_source(spark, sf):
    t = Tables(spark, sf)
    return T.nearest_flag(t.cells(), t.flags()).select("cell_id", "src_row", "src_col")


HAND = dict(ACC, chan="SELECT row, col, elev FROM accs JOIN cells USING (cell_id) WHERE acc >= 10", hand="""SELECT c.cell_id, greatest(c.elev - arg_min(h.elev,
   struct_pack(d := pow(c.row - h.row, 2) + pow(c.col - h.col, 2), r := h.row, c := h.col)), 0.0e0) AS hand, any_value(acc) AS acc FROM cells c JOIN accs USING (cell_id), chan h GROUP BY c.cell_id, c.elev""")


@query("height_above_drainage", "D11", twin("SELECT cell_id, round(hand, 6) AS hand FROM hand", "flow", recursive=True, extra=HAND))
def height_above_drainage(spark, sf):
    c = Tables(spark, sf).cells()
    acc = T.flow_accumulation(T.flow_direction(c))
    return T.height_above_drainage(c, acc, channel_cells=10).select("cell_id", r6("hand"))


@query("floodprone_index", "D12", twin("""SELECT cell_id, round(least(1.0e0, greatest(0.0e0, 1 - hand / 25.0e0)) * least(1.0e0, greatest(0.0e0, (log10(greatest(acc * 10000.0e0, 1)) - 4) / 2.0e0)), 6) AS flood_index
 FROM hand""", "flow", recursive=True, extra=HAND))
def floodprone_index(spark, sf):
    c = Tables(spark, sf).cells()
    acc = T.flow_accumulation(T.flow_direction(c))
    h = T.height_above_drainage(c, acc, channel_cells=10).withColumn("acc", F.col("acc") * 10000.0)
    return T.flood_index(h).select("cell_id", r6("flood_index"))


VIEW = {"eff": """SELECT cell_id, degrees(atan(tan(radians(slope_deg)) * cos(radians((degrees(aspect) % 360 + 360) % 360 - 437.0e0)))) AS a, degrees(atan(tan(radians(slope_deg)) * cos(radians((degrees(aspect) % 360 + 360) % 360 - 283.0e0)))) AS d
   FROM surf WHERE cell_id IN (SELECT cell_id FROM sources)""", "inc": "SELECT unnest([29.0e0, 39.0e0, 46.0e0]) AS i"}


@query("view_geometry", "D13", twin("""SELECT 'ascending' AS orbit, i AS incidence, round(avg((a >= i)::INT), 6) AS layover, round(avg((a <= i - 90)::INT), 6) AS shadow, round(avg((a < i AND a > i - 90)::INT), 6) AS usable FROM eff, inc GROUP BY i
 UNION ALL SELECT 'descending', i, round(avg((d >= i)::INT), 6), round(avg((d <= i - 90)::INT), 6), round(avg((d < i AND d > i - 90)::INT), 6) FROM eff, inc GROUP BY i
 UNION ALL SELECT 'either', i, NULL, NULL, round(avg(((a < i AND a > i - 90) OR (d < i AND d > i - 90))::INT), 6) FROM eff, inc GROUP BY i
 UNION ALL SELECT 'both', i, NULL, NULL, round(avg((a < i AND a > i - 90 AND d < i AND d > i - 90)::INT), 6) FROM eff, inc GROUP BY i""", "surf", "sources", extra=VIEW))
def view_geometry(spark, sf):
    t = Tables(spark, sf)
    slid = T.surface(t.cells()).join(t.sources().select("cell_id").distinct(), "cell_id", "left_semi")
    v = T.view_geometry(slid, "slope_deg", "aspect_deg")
    return v.select("orbit", "incidence", r6("layover"), r6("shadow"), r6("usable"))


@query("texture_check", "D14", """SELECT round(avg((abs(l_quantity + l_linenumber + l_discount - 30) <= 5)::INT), 6) AS share_closing,
 round(avg((l_quantity >= l_linenumber AND l_linenumber >= l_discount)::INT), 6) AS share_monotone FROM lineitem""")
def texture_check(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    c = T.texture_check(li, ["l_quantity", "l_linenumber", "l_discount"], 30.0, 5.0, ["l_quantity", "l_linenumber", "l_discount"])
    return c.select(r6("share_closing"), r6("share_monotone"))


@query("relief_check", "D15", twin("""SELECT round((SELECT 100.0e0 * tan(radians(quantile_cont(slope_deg, 0.5))) FROM surf), 6) AS drop_from_slope,
 round((SELECT quantile_cont(r, 0.5) FROM (SELECT max(elev) - min(elev) AS r FROM cells GROUP BY row // 4, col // 4)), 6) AS median_relief""", "surf"))
def relief_check(spark, sf):
    from ..operators.ranking import percentiles
    c = Tables(spark, sf).cells()
    relief = c.groupBy(F.floor(F.col("row") / 4).alias("r"), F.floor(F.col("col") / 4).alias("c")).agg((F.max("elev") - F.min("elev")).alias("relief"))
    med = percentiles(T.surface(c), "slope_deg", [0.5])
    return med.select(r6(F.lit(100.0) * F.tan(F.radians("p0")), "drop_from_slope")).withColumn(
        "median_relief", F.round(percentiles(relief, "relief", [0.5]).select("p0").scalar(), 6))
