"""Spatial queries: polygons, burning, sampling, nearest neighbours, corridors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice as L
from ..operators import overlay as V
from ..operators import spatial as S
from ..operators import terrain as T
from .fixtures import Tables
from . import q_terrain  # noqa: F401  (registers shared SQL)
from .q_rain import r6
from .registry import query
from .twins import register_cte, twin

register_cte("inpoly", ("cells", "edges"), """SELECT fid, row, col, cell_id FROM (SELECT e.fid, c.row, c.col, c.cell_id, count(*) AS k FROM cells c JOIN edges e
  ON (e.y1 > c.row + 0.5e0) <> (e.y2 > c.row + 0.5e0) AND c.col + 0.5e0 < e.x1 + (c.row + 0.5e0 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY 1, 2, 3, 4) WHERE k % 2 = 1""")
register_cte("touched", ("cells", "edges", "inpoly"), """SELECT DISTINCT fid, row, col FROM (SELECT fid, row, col FROM inpoly UNION ALL
  SELECT e.fid, c.row, c.col FROM cells c JOIN edges e ON floor(least(x1, x2)) <= c.col AND c.col <= floor(greatest(x1, x2)) AND floor(least(y1, y2)) <= c.row AND c.row <= floor(greatest(y1, y2)))""")
register_cte("pts", (), """SELECT o_orderkey AS pid, (o_orderkey % 1000) / 10.0e0 AS x, (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 10.0e0 AS y, o_orderstatus AS layer FROM orders""")


def pts(t: Tables):
    return t.raw("orders").select(
        F.col("o_orderkey").alias("pid"), (F.pmod(F.col("o_orderkey"), F.lit(1000)) / 10.0).alias("x"),
        (F.pmod(F.floor("o_totalprice"), F.lit(1000)) / 10.0).alias("y"), F.col("o_orderstatus").alias("layer"))


@query("geometry_measures", "B13", twin("""SELECT e.fid, round(abs(sum(CASE WHEN part = 0 THEN a ELSE 0 END)) - abs(sum(CASE WHEN part = 1 THEN a ELSE 0 END)), 6) AS area, round(sum(len), 6) AS length,
 round(avg(CASE WHEN part = 0 THEN vx END), 6) AS ring_x, round(avg(CASE WHEN part = 0 THEN vy END), 6) AS ring_y, count(DISTINCT part) AS parts
 FROM (SELECT fid, part, sum(x1 * y2 - x2 * y1) / 2 AS a, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS len, avg(x1) AS vx, avg(y1) AS vy FROM edges GROUP BY 1, 2) e GROUP BY 1""", "edges"))
def geometry_measures(spark, sf):
    g = S.geometry_measures(Tables(spark, sf).verts())
    return g.select("fid", r6("area"), r6("length"), r6("ring_x"), r6("ring_y"), "parts")


@query("polygon_centroids", "B13", twin("""SELECT fid, round((64.0e0 * (x0 + 4.25e0) - h * (x0 + 4.25e0)) / (64.0e0 - h), 6) AS cx, round((64.0e0 * (y0 + 4.25e0) - h * (y0 + 4.25e0)) / (64.0e0 - h), 6) AS cy
 FROM (SELECT s_suppkey AS fid, 10.0e0 * (s_suppkey % 10) AS x0, 10.0e0 * (s_suppkey // 10) AS y0, CASE WHEN s_suppkey % 2 = 0 THEN 4.0e0 ELSE 0.0e0 END AS h FROM supplier)"""))
def polygon_centroids(spark, sf):
    return S.geometry_measures(Tables(spark, sf).verts()).select("fid", r6("cx"), r6("cy"))


@query("cells_in_polygons", "E1 C10", twin("SELECT fid, row, col FROM inpoly", "inpoly"))
def cells_in_polygons(spark, sf):
    t = Tables(spark, sf)
    return S.fill_polygons(t.verts()).join(t.cells().select("row", "col"), ["row", "col"], "left_semi").select("fid", "row", "col")


@query("points_in_polygons", "E2", twin("""SELECT pid, fid FROM (SELECT p.pid, e.fid, count(*) AS k FROM pts p JOIN edges e
  ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY 1, 2) WHERE k % 2 = 1""", "pts", "edges"))
def points_in_polygons(spark, sf):
    t = Tables(spark, sf)
    return V.inside(pts(t), t.verts(), "pid", 8.0)


@query("touched_cells", "E3", twin("SELECT fid, row, col FROM touched", "touched"))
def touched_cells(spark, sf):
    t = Tables(spark, sf)
    return S.touched_cells(t.verts()).join(t.cells().select("row", "col"), ["row", "col"], "left_semi").select("fid", "row", "col")


register_cte("wide_in", ("cells", "edges"), """SELECT fid, row, col FROM (SELECT e.fid, c.row, c.col, count(*) AS k FROM cells c JOIN edges e
  ON (e.y1 * 1.5e0 > c.row + 0.5e0) <> (e.y2 * 1.5e0 > c.row + 0.5e0) AND c.col + 0.5e0 < e.x1 * 0.8e0 + (c.row + 0.5e0 - e.y1 * 1.5e0) * (e.x2 * 0.8e0 - e.x1 * 0.8e0) / (e.y2 * 1.5e0 - e.y1 * 1.5e0)
  GROUP BY 1, 2, 3) WHERE k % 2 = 1""")


@query("burn_attribute", "E4", twin("""SELECT row, col, arg_max(fid % 7, fid) AS code FROM (SELECT fid, row, col FROM inpoly UNION ALL SELECT fid, row, col FROM wide_in) GROUP BY 1, 2""", "inpoly", "wide_in"))
def burn_attribute(spark, sf):
    t = Tables(spark, sf)
    v = t.verts()
    wide = v.withColumn("x", F.col("x") * 0.8).withColumn("y", F.col("y") * 1.5).withColumn("part", F.col("part") + 10)
    filled = S.fill_polygons(v).unionByName(S.fill_polygons(wide))
    b = S.burn(filled, F.pmod(F.col("fid"), F.lit(7)), F.col("fid"))
    return b.join(t.cells().select("row", "col"), ["row", "col"], "left_semi").select("row", "col", "code")


@query("source_bitmask", "E5 L1", twin("""SELECT cell_id, CAST(bit_or(1 << bit) AS INT) AS mask, CAST(count(DISTINCT bit) AS INT) AS n_sources FROM sources GROUP BY 1""", "sources"))
def source_bitmask(spark, sf):
    return S.source_bitmask(Tables(spark, sf).sources())


@query("clip_points_and_lines", "E6", twin("""SELECT kind, count(*) AS n FROM (
 SELECT DISTINCT 'point' AS kind, p.pid AS a, 0 AS b FROM pts p JOIN (SELECT p.pid, e.fid, count(*) AS k FROM pts p JOIN edges e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY 1, 2) i ON i.pid = p.pid WHERE k % 2 = 1
 UNION ALL SELECT DISTINCT 'line', pid, seq FROM (SELECT m.pid, m.seq, e.fid, count(*) AS k FROM mids m JOIN edges e ON (e.y1 > m.y) <> (e.y2 > m.y) AND m.x < e.x1 + (m.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY 1, 2, 3) WHERE k % 2 = 1) GROUP BY 1""",
 "pts", "edges", "lines", extra={"mids": """SELECT fid AS pid, seq, ((x + lead(x) OVER w) / 2 - 92) * 500 AS x, ((y + lead(y) OVER w) / 2 - 27) * 500 AS y FROM lines WINDOW w AS (PARTITION BY fid ORDER BY seq)"""}))
def clip_points_and_lines(spark, sf):
    t = Tables(spark, sf)
    v = t.verts()
    p = V.inside(pts(t), v, "pid", 8.0).select(F.lit("point").alias("kind"), "pid", F.lit(0).alias("seq")).distinct()
    e = S.edges(t.lines())
    mids = e.select(
        F.struct("fid", "seq").alias("key"), (((F.col("x1") + F.col("x2")) / 2 - 92) * 500).alias("x"), (((F.col("y1") + F.col("y2")) / 2 - 27) * 500).alias("y"))
    m = V.inside(mids, v, "key", 8.0).select(F.lit("line").alias("kind"), F.col("key.fid").alias("pid"), F.col("key.seq").alias("seq")).distinct()
    return p.unionByName(m).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("box_and_inside_counts", "E7 I17", twin("""SELECT layer, count(*) FILTER (WHERE x BETWEEN w AND e AND y BETWEEN s AND n) AS n_box,
 count(*) FILTER (WHERE pid IN (SELECT pid FROM (SELECT p.pid, e.fid, count(*) AS k FROM pts p JOIN edges e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY 1, 2) WHERE k % 2 = 1)) AS n_inside
 FROM pts, (SELECT min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM verts) GROUP BY 1""", "pts", "verts", "edges"))
def box_and_inside_counts(spark, sf):
    t = Tables(spark, sf)
    return V.box_and_inside_counts(pts(t), t.verts(), "layer", "pid", 8.0)


@query("overlap_count", "E8", """WITH k AS (SELECT s_suppkey AS k, 10 * (s_suppkey % 10) AS x, 10 * (s_suppkey // 10) AS y, s_suppkey % 2 AS odd FROM supplier),
 t AS (SELECT k, odd, c, r FROM k, (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j), LATERAL (SELECT x + i + 9 * odd AS c, y + j AS r) WHERE odd = 1 OR NOT (i BETWEEN 4 AND 4 AND j BETWEEN 4 AND 4))
 SELECT count(DISTINCT a.k) AS n_overlap, (SELECT count(*) FROM k WHERE odd = 0) AS n_a, (SELECT count(*) FROM k WHERE odd = 1) AS n_b,
  (SELECT count(*) FROM k) - count(DISTINCT a.k) AS n_unique FROM t a JOIN t b ON a.odd = 0 AND b.odd = 1 AND a.c = b.c AND a.r = b.r""")
def overlap_count(spark, sf):
    v = Tables(spark, sf).verts()
    odd = F.pmod(F.col("fid"), F.lit(2)) == 1
    return S.overlap_count(v.where(~odd), v.where(odd).withColumn("x", F.col("x") + 9))


# lines in map units beside the squares of the polygon fixture; a segment inside a square is found by its slabs, not by crossings
register_cte("maplines", ("lines",), """SELECT fid, seq, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM (SELECT fid, seq, (x - 92) * 500 AS x1, (y - 27) * 500 AS y1,
  (lead(x) OVER w - 92) * 500 AS x2, (lead(y) OVER w - 27) * 500 AS y2 FROM lines WINDOW w AS (PARTITION BY fid ORDER BY seq)) WHERE x2 IS NOT NULL""")
register_cte("boxes", (), """SELECT s_suppkey AS other, 10.0e0 * (s_suppkey % 10) + lo AS w, 10.0e0 * (s_suppkey // 10) + lo AS s, side, sign FROM supplier,
  (VALUES (0.25e0, 8.0e0, 1), (3.25e0, 2.0e0, -1)) r(lo, side, sign) WHERE sign = 1 OR s_suppkey % 2 = 0""")
register_cte("small_squares", (), """SELECT s_suppkey AS fid, 10.0e0 * (s_suppkey % 10) + (s_suppkey * 7 % 40) / 4.0e0 AS w, 10.0e0 * (s_suppkey // 10) + (s_suppkey * 13 % 40) / 4.0e0 AS s, 0.75e0 AS side FROM supplier""")


def map_lines(t: Tables):
    return t.lines().withColumn("x", (F.col("x") - 92) * 500).withColumn("y", (F.col("y") - 27) * 500)


def small_squares(t: Tables):
    """A square of side 0.75 somewhere in the pitch of each polygon of ``verts``: in it, in its hole, on its edge or beside it."""
    k = F.col("s_suppkey")
    x0, y0 = F.pmod(k, F.lit(10)) * 10.0 + F.pmod(k * 7, F.lit(40)) / 4.0, F.floor(k / 10) * 10.0 + F.pmod(k * 13, F.lit(40)) / 4.0
    ring = [F.struct(F.lit(0).alias("part"), F.lit(i).alias("seq"), (x0 + 0.75 * a).alias("x"), (y0 + 0.75 * b).alias("y")) for i, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]
    return t.raw("supplier").select(k.alias("fid"), F.explode(F.array(*ring)).alias("v")).select("fid", "v.*")


@query("clipped_lines", "E6", twin("""SELECT fid, other, round(sum(sign * greatest(0.0e0, t1 - t0) * sqrt(dx * dx + dy * dy)), 6) AS length FROM (
 SELECT l.*, b.other, b.sign, greatest(0.0e0, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN w AND w + side THEN 0.0e0 ELSE 2.0e0 END ELSE least((w - x1) / dx, (w + side - x1) / dx) END,
   CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN s AND s + side THEN 0.0e0 ELSE 2.0e0 END ELSE least((s - y1) / dy, (s + side - y1) / dy) END) AS t0,
  least(1.0e0, CASE WHEN dx = 0 THEN 1.0e0 ELSE greatest((w - x1) / dx, (w + side - x1) / dx) END, CASE WHEN dy = 0 THEN 1.0e0 ELSE greatest((s - y1) / dy, (s + side - y1) / dy) END) AS t1
  FROM maplines l JOIN boxes b ON least(x1, x1 + dx) <= w + side AND greatest(x1, x1 + dx) >= w AND least(y1, y1 + dy) <= s + side AND greatest(y1, y1 + dy) >= s)
 GROUP BY 1, 2 HAVING round(sum(sign * greatest(0.0e0, t1 - t0) * sqrt(dx * dx + dy * dy)), 6) > 0""", "maplines", "boxes"))
def clipped_lines(spark, sf):
    t = Tables(spark, sf)
    c = V.clip_lines(map_lines(t), t.verts(), 8.0)
    return c.groupBy("fid", "other").agg(r6(F.sum("length"), "length")).where("length > 0")


@query("clipped_points", "E6", twin("""SELECT pid, layer, x, y FROM pts p WHERE EXISTS (SELECT 1 FROM boxes b WHERE sign = 1 AND p.x >= w AND p.x < w + side AND p.y >= s AND p.y < s + side
 AND NOT EXISTS (SELECT 1 FROM boxes h WHERE h.sign = -1 AND h.other = b.other AND p.x >= h.w AND p.x < h.w + h.side AND p.y >= h.s AND p.y < h.s + h.side))""", "pts", "boxes"))
def clipped_points(spark, sf):
    t = Tables(spark, sf)
    return V.clip_points(pts(t), t.verts(), "pid", 8.0).select("pid", "layer", "x", "y")


_MEET = """FROM small_squares q JOIN boxes b ON b.sign = 1 AND q.w <= b.w + b.side AND q.w + q.side >= b.w AND q.s <= b.s + b.side AND q.s + q.side >= b.s
 LEFT JOIN boxes h ON h.sign = -1 AND h.other = b.other WHERE h.other IS NULL OR NOT (q.w > h.w AND q.w + q.side < h.w + h.side AND q.s > h.s AND q.s + q.side < h.s + h.side)"""


@query("intersecting_polygons", "E8", twin(f"SELECT q.fid, b.other {_MEET}", "small_squares", "boxes"))
def intersecting_polygons(spark, sf):
    t = Tables(spark, sf)
    return V.intersecting(small_squares(t), t.verts(), 4.0).select("fid", "other")


@query("intersection_counts", "E8", twin(f"""SELECT count(DISTINCT fid) AS n_overlap, (SELECT count(*) FROM supplier) AS n_a, (SELECT count(*) FROM supplier) AS n_b,
 2 * (SELECT count(*) FROM supplier) - count(DISTINCT fid) AS n_unique FROM (SELECT q.fid {_MEET})""", "small_squares", "boxes"))
def intersection_counts(spark, sf):
    t = Tables(spark, sf)
    return V.intersection_counts(small_squares(t), t.verts(), 4.0).select("n_overlap", "n_a", "n_b", "n_unique")


@query("sample_at_points", "E9 H3", twin("""SELECT pid, c.elev FROM pts JOIN cells c ON c.row = CAST(floor(y) AS INT) AND c.col = CAST(floor(x) AS INT)""", "pts", "cells"))
def sample_at_points(spark, sf):
    t = Tables(spark, sf)
    p = pts(t).select("pid", L.cell_id(F.floor("y"), F.floor("x")).alias("cell_id"))
    return p.join(t.cells().select("cell_id", "elev"), "cell_id").select("pid", "elev")


@query("nearest_station", "E10", twin("""SELECT place_id, arg_min(station, struct_pack(d := d, s := station)) AS station, round(min(d), 6) AS dist FROM (
 SELECT place_id, station, sqrt(pow(p.lat - s.lat, 2) + pow((p.lon - s.lon) * cos(radians(p.lat)), 2)) AS d FROM places p, stations s) GROUP BY 1""", "places", "stations"))
def nearest_station(spark, sf):
    t = Tables(spark, sf)
    p = t.places().select("place_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    d = L.degrees_cos(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    n = S.nearest(p, t.stations(), "place_id", ["station"], (F.col("plon"), F.col("plat")), (F.col("lon"), F.col("lat")), 0.05, d,
                  x_scale=F.cos(F.radians("plat")))
    return n.select("place_id", "station", r6("dist"))


@query("nearest_place", "E11", twin("""SELECT station, arg_min(place_id, struct_pack(d := d, s := place_id)) AS place_id, round(min(d), 6) AS km FROM (
 SELECT place_id, station, sqrt(pow(p.lat - s.lat, 2) + pow((p.lon - s.lon) * 0.89e0, 2)) * 111.0e0 AS d FROM places p, stations s WHERE kind = 'town') GROUP BY 1""", "places", "stations"))
def nearest_place(spark, sf):
    t = Tables(spark, sf)
    s = t.stations().select("station", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    towns = t.places().where(F.col("kind") == "town")
    d = L.km_shrunk(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    n = S.nearest(s, towns, "station", ["place_id"], (F.col("slon") * 0.89, F.col("slat")), (F.col("lon") * 0.89, F.col("lat")), 0.02, d)
    return n.select("station", "place_id", r6("dist", "km"))


@query("snap_to_assessed", "E12", twin("""SELECT p.cell_id, arg_min(c.row, struct_pack(d := pow(c.row - p.row, 2) + pow(c.col - p.col, 2), r := c.row, c := c.col)) AS snap_row,
 arg_min(c.col, struct_pack(d := pow(c.row - p.row, 2) + pow(c.col - p.col, 2), r := c.row, c := c.col)) AS snap_col, round(sqrt(min(pow(c.row - p.row, 2) + pow(c.col - p.col, 2))), 6) AS snap_dist
 FROM cells p LEFT JOIN cells c ON c.slope > 40 AND abs(c.row - p.row) <= 10 AND abs(c.col - p.col) <= 10 GROUP BY 1""", "cells"))
def snap_to_assessed(spark, sf):
    c = Tables(spark, sf).cells()
    s = S.snap_within(c, c.where(F.col("slope") > 40), "cell_id", 10)
    return s.select("cell_id", "snap_row", "snap_col", r6("snap_dist"))


@query("nearest_floodplain", "E13", twin("""SELECT p.cell_id, CAST(min(greatest(abs(f.row - p.row), abs(f.col - p.col))) AS INT) AS rings,
 arg_min(f.row, struct_pack(k := greatest(abs(f.row - p.row), abs(f.col - p.col)), d := pow(f.row - p.row, 2) + pow(f.col - p.col, 2), r := f.row, c := f.col)) AS flood_row,
 arg_min(f.col, struct_pack(k := greatest(abs(f.row - p.row), abs(f.col - p.col)), d := pow(f.row - p.row, 2) + pow(f.col - p.col, 2), r := f.row, c := f.col)) AS flood_col
 FROM cells p LEFT JOIN flags f ON greatest(abs(f.row - p.row), abs(f.col - p.col)) <= 40 GROUP BY 1""", "cells", "flags"))
def nearest_floodplain(spark, sf):
    t = Tables(spark, sf)
    return S.nearest_by_rings(t.cells(), t.flags(), "cell_id").select("cell_id", "flood_row", "flood_col", "rings")


@query("corridor_cells", "E14", twin("""SELECT DISTINCT c.row, c.col FROM cells c JOIN flags f ON abs(c.row - f.row) <= 2 AND abs(c.col - f.col) <= 2
  AND pow((c.row - f.row) * 0.55e0, 2) + pow((c.col - f.col) * 0.5e0, 2) <= 1.0e0""", "cells", "flags"))
def corridor_cells(spark, sf):
    t = Tables(spark, sf)
    k = S.corridor(t.flags(), 100_000, 100_000, 0.55, 0.5, 1.0)
    return k.join(t.cells().select("row", "col"), ["row", "col"], "left_semi").select("row", "col")


@query("beyond_label_buffer", "E15", twin("SELECT cell_id FROM near WHERE sqrt(d2) * 100 > 150", "near"))
def beyond_label_buffer(spark, sf):
    t = Tables(spark, sf)
    return T.nearest_flag(t.cells(), t.flags()).where(F.col("dist") * 100 > 150).select("cell_id")


@query("attribute_filters", "E16", "SELECT p_type AS lith, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size > 5 AND p_type NOT LIKE '%PROMO%' GROUP BY 1")
def attribute_filters(spark, sf):
    p = Tables(spark, sf).raw("part")
    k = p.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & (F.col("p_size") > 5) & ~F.col("p_type").contains("PROMO"))
    return k.groupBy(F.col("p_type").alias("lith")).agg(F.count(F.lit(1)).alias("n"))


@query("representative_points", "E17 H9", twin("SELECT row, col FROM cells WHERE row % 3 = 0 AND col % 3 = 0 AND cell_id IN (SELECT cell_id FROM pc)", "cells", "pc"))
def representative_points(spark, sf):
    from ..operators.lattice import representative_points as rp
    t = Tables(spark, sf)
    return rp(t.cells().select("cell_id", "row", "col"), t._part_cells(), 3, "cell_id").select("row", "col")


BOX = {"bx": "SELECT fid, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM verts GROUP BY 1"}


@query("district_table_boxes", "E18", twin("""SELECT fid, round(avg((slope > 30)::INT), 6) AS high_share, max(slope) AS top, count(*) AS n FROM bx JOIN cells ON col + 0.5e0 BETWEEN w AND e AND row + 0.5e0 BETWEEN s AND n GROUP BY 1""", "verts", "cells", extra=BOX))
def district_table_boxes(spark, sf):
    t = Tables(spark, sf)
    c = t.cells().withColumn("x", F.col("col") + 0.5).withColumn("y", F.col("row") + 0.5)
    j = S.points_in_boxes(c.select("x", "y", "slope"), S.bounds(t.verts()), 8.0)
    return j.groupBy("fid").agg(r6(F.avg((F.col("slope") > 30).cast("double")), "high_share"), F.max("slope").alias("top"), F.count(F.lit(1)).alias("n"))


@query("district_table_exact", "E18 E2", twin("""SELECT fid, round(avg((slope > 30)::INT), 6) AS high_share, max(slope) AS top, count(*) AS n FROM inpoly JOIN cells USING (cell_id) GROUP BY 1""", "inpoly"))
def district_table_exact(spark, sf):
    t = Tables(spark, sf)
    j = S.fill_polygons(t.verts()).join(t.cells().select("row", "col", "slope"), ["row", "col"])
    return j.groupBy("fid").agg(r6(F.avg((F.col("slope") > 30).cast("double")), "high_share"), F.max("slope").alias("top"), F.count(F.lit(1)).alias("n"))
