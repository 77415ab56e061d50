"""Road queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice as L
from ..operators import roads as Rd
from ..operators import spatial as S
from . import q_hazard  # noqa: F401  (registers shared SQL)
from ..functions.text import seeded_key
from .fixtures import Tables
from .q_rain import r6
from .registry import query
from .twins import register_cte, twin

register_cte("seg", ("lines",), """SELECT *, sum(km) OVER (PARTITION BY fid ORDER BY seq) - km AS c0, sum(km) OVER (PARTITION BY fid ORDER BY seq) AS c1, sum(km) OVER (PARTITION BY fid) AS len FROM (
  SELECT fid, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, sqrt(pow((lead(x) OVER w - x) * 98.9e0, 2) + pow((lead(y) OVER w - y) * 110.6e0, 2)) AS km FROM lines WINDOW w AS (PARTITION BY fid ORDER BY seq)) WHERE x2 IS NOT NULL""")
register_cte("cuts", ("seg",), """SELECT q.fid, j, n, q.len, s.x1 + least(1.0e0, greatest(0.0e0, (d - c0) / km)) * (s.x2 - s.x1) AS px, s.y1 + least(1.0e0, greatest(0.0e0, (d - c0) / km)) * (s.y2 - s.y1) AS py FROM (
  SELECT k.fid, k.n, k.len, j, j * len / n AS d FROM (SELECT fid, any_value(len) AS len, CAST(greatest(1, round_even(any_value(len) / 2.0e0, 0)) AS BIGINT) AS n FROM seg WHERE len > 0 GROUP BY fid) k, LATERAL (SELECT unnest(range(k.n + 1)) AS j)) q
  ASOF JOIN seg s ON s.fid = q.fid AND q.d + 1e-12 >= s.c0""")
register_cte("chunks", ("cuts",), """SELECT a.fid, a.j AS piece, a.len / a.n AS km, (a.py + b.py) / 2 AS lat, (a.px + b.px) / 2 AS lon FROM cuts a JOIN cuts b ON b.fid = a.fid AND b.j = a.j + 1""")


def lines(t: Tables):
    return t.lines().withColumn("seq", F.col("seq").cast("int"))


@query("line_chainage", "J6 B13", twin("SELECT fid, CAST(seq AS INT) AS seq, round(c0, 6) + 0.0e0 AS from_km, round(c1, 6) AS to_km, round(len, 6) AS length FROM seg", "seg"))
def line_chainage(spark, sf):
    c = Rd.chainage(lines(Tables(spark, sf)))
    return c.select("fid", "seq", r6(F.abs("from_km"), "from_km"), r6("to_km"), r6("length"))


@query("road_pieces", "O1", twin("SELECT fid, piece, round(km, 6) AS km, round(lat, 6) AS lat, round(lon, 6) AS lon FROM chunks", "chunks"))
def road_pieces(spark, sf):
    return Rd.chunk_lines(lines(Tables(spark, sf)), 2.0).select("fid", "piece", r6("km"), r6("lat"), r6("lon"))


PX = "CAST(floor((lat - 27) * 400) AS BIGINT) * 100000 + CAST(floor((lon - 92) * 400) AS BIGINT)"


def cell_of(lat="lat", lon="lon"):
    return L.cell_id(F.floor((F.col(lat) - 27) * 400), F.floor((F.col(lon) - 92) * 400))


@query("sampled_classes", "O2", twin(f"SELECT coalesce(cls, 0) AS cls, count(*) AS n, round(sum(km), 5) AS km FROM (SELECT *, {PX} AS cell_id FROM chunks) LEFT JOIN classed USING (cell_id) GROUP BY 1", "chunks", "classed"))
def sampled_classes(spark, sf):
    from .q_evaluate import susceptible
    t = Tables(spark, sf)
    p = Rd.chunk_lines(lines(t), 2.0).withColumn("cell_id", cell_of())
    s = Rd.sample_classes(p, susceptible(t))
    return s.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("km"), "km", 5))


HOT = {"hot": """SELECT road_id, min(seq) AS first_piece, count(*) AS pieces, sum(km) AS km, max(cls) AS peak, avg(lat) AS lat, avg(lon) AS lon FROM (SELECT *, seq - row_number() OVER (PARTITION BY road_id ORDER BY seq) AS g FROM pieces WHERE cls >= 4) GROUP BY road_id, g"""}


@query("road_hotspots", "O3", twin("SELECT road_id, CAST(first_piece AS BIGINT) AS first_piece, pieces, km, peak, round(lat, 6) AS lat, round(lon, 6) AS lon FROM hot", "pieces", extra=HOT))
def road_hotspots(spark, sf):
    h = Rd.hotspots(Tables(spark, sf).pieces())
    return h.select("road_id", F.col("first_piece").cast("long"), "pieces", "km", "peak", r6("lat"), r6("lon"))


@query("road_exposure", "O4 I12", twin("SELECT cls, sum(km) AS km FROM pieces WHERE cls > 0 GROUP BY 1", "pieces"))
def road_exposure(spark, sf):
    return Rd.exposure(Tables(spark, sf).pieces())


NODE = "CAST(round_even({y} / (120.0e0 / 111000.0e0), 0) * 10000000 + round_even({x} / (120.0e0 / 111000.0e0), 0) AS BIGINT)"
register_cte("net", ("seg",), f"""SELECT a AS src, b AS dst, min(km) AS km FROM (SELECT a, b, km FROM (SELECT {NODE.format(y='y1', x='x1')} AS a, {NODE.format(y='y2', x='x2')} AS b, km FROM seg) UNION ALL
  SELECT b, a, km FROM (SELECT {NODE.format(y='y1', x='x1')} AS a, {NODE.format(y='y2', x='x2')} AS b, km FROM seg)) WHERE a <> b GROUP BY 1, 2""")


@query("road_network_edges", "O5", twin("SELECT src, dst, round(km, 6) AS km FROM net", "net"))
def road_network_edges(spark, sf):
    return Rd.build_edges(lines(Tables(spark, sf))).select("src", "dst", r6("km"))




@query("network_components", "O6", twin("""SELECT count(*) AS components, CAST(sum(n) AS BIGINT) AS nodes, round(max(n) / sum(n), 6) AS largest_share FROM (SELECT label, count(*) AS n FROM lb GROUP BY 1)""", "net", recursive=True, extra={
 "lb(node, label) USING KEY (node)": "SELECT DISTINCT src, src FROM net UNION SELECT e.dst, min(l.label) FROM lb l JOIN net e ON e.src = l.node JOIN recurring.lb r ON r.node = e.dst WHERE l.label < r.label GROUP BY e.dst"}))
def network_components(spark, sf):
    from ..session import durable
    e = durable(Rd.build_edges(lines(Tables(spark, sf))))
    return Rd.component_shares(Rd.components(e)).select("components", "nodes", r6("largest_share"))


@query("shortest_distances", "O7", twin("SELECT node, round(km, 6) AS km FROM d", "net", recursive=True, extra={
 "d(node, km) USING KEY (node)": "SELECT min(src), 0.0e0 FROM net UNION SELECT e.dst, min(d.km + e.km) FROM d JOIN net e ON e.src = d.node LEFT JOIN recurring.d r ON r.node = e.dst WHERE r.km IS NULL OR d.km + e.km < r.km GROUP BY e.dst"}))
def shortest_distances(spark, sf):
    from ..session import durable
    e = durable(Rd.build_edges(lines(Tables(spark, sf))))
    origin = e.agg(F.min("src").alias("node"))
    return Rd.shortest_distances(e, origin, before=False).select("node", r6("km"))


@query("distances_from_many_origins", "O7", twin("SELECT origin, node, round(km, 6) AS km FROM d", "net", recursive=True, extra={
 "start": "SELECT src AS origin FROM (SELECT DISTINCT src FROM net) ORDER BY md5(src || '|5'), src LIMIT 25",
 "d(origin, node, km) USING KEY (origin, node)": """SELECT origin, origin, 0.0e0 FROM start UNION SELECT d.origin, e.dst, min(d.km + e.km) FROM d JOIN net e ON e.src = d.node
   LEFT JOIN recurring.d r ON r.node = e.dst AND r.origin = d.origin WHERE r.km IS NULL OR d.km + e.km < r.km GROUP BY d.origin, e.dst"""}))
def distances_from_many_origins(spark, sf):
    """From 25 nodes drawn by hash to every node they reach."""
    from ..session import durable
    e = durable(Rd.build_edges(lines(Tables(spark, sf))))
    origins = e.select(F.col("src").alias("node")).distinct().orderBy(seeded_key(5, "node"), "node").limit(25)
    return Rd.shortest_distances(e, durable(origins), before=False).select("origin", "node", r6("km"))


@query("snap_to_network", "O8", twin(f"""SELECT place_id, round(min(d), 6) AS off_km FROM (SELECT place_id, sqrt(pow((p.lat - n.lat) * 110.6e0, 2) + pow((p.lon - n.lon) * 98.9e0, 2)) AS d FROM places p,
 (SELECT {NODE.format(y='y', x='x')} AS node, arg_max(y, struct_pack(f := fid, s := seq)) AS lat, arg_max(x, struct_pack(f := fid, s := seq)) AS lon FROM lines GROUP BY 1) n) GROUP BY 1""", "places", "lines"))
def snap_to_network(spark, sf):
    t = Tables(spark, sf)
    nodes = Rd.node_positions(lines(t)).select("node", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    km = L.km_local(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    n = S.nearest(t.places(), nodes, "place_id", ["node"], (F.col("lon") * 98.9, F.col("lat") * 110.6), (F.col("nlon") * 98.9, F.col("nlat") * 110.6), 0.2, km)
    return n.select("place_id", r6("dist", "off_km"))


register_cte("dense", ("seg",), """SELECT q.fid, j, d AS km, s.y1 + least(1.0e0, greatest(0.0e0, (d - c0) / s.km)) * (s.y2 - s.y1) AS lat, s.x1 + least(1.0e0, greatest(0.0e0, (d - c0) / s.km)) * (s.x2 - s.x1) AS lon FROM (
  SELECT fid, j, j * 0.5e0 AS d FROM (SELECT fid, any_value(len) AS len FROM seg WHERE len > 0 GROUP BY fid) k, LATERAL (SELECT unnest(range(CAST(ceil(k.len / 0.5e0) AS BIGINT))) AS j)) q ASOF JOIN seg s ON s.fid = q.fid AND q.d + 1e-12 >= s.c0""")


@query("densified_lines", "O9", twin("SELECT fid, j, km, round(lat, 6) AS lat, round(lon, 6) AS lon FROM dense", "dense"))
def densified_lines(spark, sf):
    return Rd.densify(lines(Tables(spark, sf)), 0.5).select("fid", "j", "km", r6("lat"), r6("lon"))


@query("route_profiles", "O10", twin(f"""SELECT fid, count(*) * 0.5e0 AS km, max(elev) AS top_elev, count(*) FILTER (WHERE cls >= 4) * 0.5e0 AS high_km, arg_min(km, struct_pack(c := -cls, k := km)) AS worst_at_km, max(cls) AS worst_cls
 FROM (SELECT fid, km, elev, coalesce(cls, 0) AS cls FROM (SELECT *, {PX} AS cell_id FROM dense) LEFT JOIN classed USING (cell_id) LEFT JOIN (SELECT cell_id, elev FROM cells) USING (cell_id)) GROUP BY 1""", "dense", "classed", "cells"))
def route_profiles(spark, sf):
    from .q_evaluate import susceptible
    t = Tables(spark, sf)
    p = Rd.densify(lines(t), 0.5).withColumn("cell_id", cell_of())
    return Rd.route_summary(Rd.route_profile(p, susceptible(t)), 0.5)


@query("worst_stretches", "O11 K1 E11", twin("""SELECT h.road_id, CAST(first_piece AS BIGINT) AS first_piece, km, peak, arg_min(place_id, struct_pack(d := d, p := place_id)) AS place_id, round(min(d), 6) AS place_km FROM
 (SELECT * FROM hot ORDER BY peak DESC, km DESC, road_id, first_piece LIMIT 60) h, LATERAL (SELECT place_id, sqrt(pow(p.lat - h.lat, 2) + pow((p.lon - h.lon) * 0.89e0, 2)) * 111.0e0 AS d FROM places p) GROUP BY 1, 2, 3, 4""", "pieces", "places", extra=HOT))
def worst_stretches(spark, sf):
    t = Tables(spark, sf)
    top = Rd.hotspots(t.pieces()).orderBy(F.desc("peak"), F.desc("km"), "road_id", "first_piece").limit(60)
    top = top.select("road_id", F.col("first_piece").cast("long").alias("first_piece"), "km", "peak", F.col("lat").alias("hlat"), F.col("lon").alias("hlon")).withColumn("rid", F.concat_ws("/", "road_id", "first_piece"))
    km = L.km_shrunk(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon"))
    n = S.nearest(top, t.places(), "rid", ["place_id"], (F.col("hlon") * 0.89, F.col("hlat")), (F.col("lon") * 0.89, F.col("lat")), 0.02, km)
    return top.join(n, "rid").select("road_id", "first_piece", "km", "peak", "place_id", r6("dist", "place_km"))
