"""Ingestion and export queries: each writes data Spark derives from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..operators import lattice as O
from ..operators import rain as R
from ..operators import series as Se
from ..session import scratch_path
from ..sources import ingest as I
from ..sources import sinks as K
from . import q_hazard  # noqa: F401  (registers shared SQL)
from .fixtures import Tables
from .q_rain import r6, txt
from .registry import query
from .twins import twin


def folded(t: Tables):
    return t.cells().select("cell_id", "row", "col", "elev", F.pmod(F.col("col"), F.lit(5)).cast("int").alias("fold"))


@query("write_and_read_grid", "A1", twin("SELECT cell_id, row, col, elev, CAST(col % 5 AS INT) AS fold FROM cells", "cells"))
def write_and_read_grid(spark, sf):
    path = scratch_path(spark, "grid")
    K.write_grid(folded(Tables(spark, sf)), path)
    return K.read_grid(spark, path).select("cell_id", "row", "col", "elev", "fold")


@query("held_out_fold", "A2", twin("SELECT 'held out' AS part, count(*) AS n, round(avg(elev), 6) AS mean FROM cells WHERE col % 5 = 2 UNION ALL SELECT 'rest', count(*), round(avg(elev), 6) FROM cells WHERE col % 5 <> 2", "cells"))
def held_out_fold(spark, sf):
    path = scratch_path(spark, "grid")
    K.write_grid(folded(Tables(spark, sf)), path)
    agg = [F.count(F.lit(1)).alias("n"), r6(F.avg("elev"), "mean")]
    a = K.read_grid(spark, path, [2]).agg(*agg).select(F.lit("held out").alias("part"), "n", "mean")
    return a.unionByName(K.read_grid(spark, path, [2], exclude=True).agg(*agg).select(F.lit("rest").alias("part"), "n", "mean"))


@query("feature_collection", "A3", twin("SELECT fid, part, CAST(seq AS INT) AS seq, x, y FROM verts", "verts"))
def feature_collection(spark, sf):
    path = scratch_path(spark, "features")
    v = Tables(spark, sf).verts()
    rings = v.groupBy("fid", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("ring"))
    geom = rings.groupBy("fid").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "ring"))), lambda p: p["ring"]).alias("coordinates"))
    feature = F.struct(F.struct(F.col("fid").alias("id")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), "coordinates").alias("geometry"))
    geom.select(F.array(feature).alias("features")).write.json(path)
    f = I.read_features(spark, path, "id bigint")
    return I.vertices(f, "id").select("fid", "part", "seq", "x", "y")


@query("geometry_types", "A3", """WITH k AS (SELECT s_suppkey AS fid, s_suppkey % 7 AS kind, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey // 10 AS DOUBLE) AS y FROM supplier),
 v(kind, geom_type, member, ring, part, seq, dx, dy) AS (VALUES (0, 'Point', 0, 0, 0, 0, 0, 0), (1, 'MultiPoint', 0, 0, 0, 0, 0, 0), (1, 'MultiPoint', 1, 0, 1, 0, 1, 2), (2, 'LineString', 0, 0, 0, 0, 0, 0), (2, 'LineString', 0, 0, 0, 1, 3, 1),
  (3, 'MultiLineString', 0, 0, 0, 0, 0, 0), (3, 'MultiLineString', 0, 0, 0, 1, 3, 1), (3, 'MultiLineString', 1, 0, 1, 0, 1, 1), (3, 'MultiLineString', 1, 0, 1, 1, 0, 4),
  (4, 'Polygon', 0, 0, 0, 0, 0, 0), (4, 'Polygon', 0, 0, 0, 1, 9, 0), (4, 'Polygon', 0, 0, 0, 2, 0, 9), (4, 'Polygon', 0, 0, 0, 3, 0, 0), (4, 'Polygon', 0, 1, 1, 0, 1, 1), (4, 'Polygon', 0, 1, 1, 1, 2, 1), (4, 'Polygon', 0, 1, 1, 2, 1, 2), (4, 'Polygon', 0, 1, 1, 3, 1, 1),
  (5, 'MultiPolygon', 0, 0, 0, 0, 0, 0), (5, 'MultiPolygon', 0, 0, 0, 1, 9, 0), (5, 'MultiPolygon', 0, 0, 0, 2, 0, 9), (5, 'MultiPolygon', 0, 0, 0, 3, 0, 0), (5, 'MultiPolygon', 0, 1, 1, 0, 1, 1), (5, 'MultiPolygon', 0, 1, 1, 1, 2, 1), (5, 'MultiPolygon', 0, 1, 1, 2, 1, 2), (5, 'MultiPolygon', 0, 1, 1, 3, 1, 1),
  (5, 'MultiPolygon', 1, 0, 2, 0, 20, 20), (5, 'MultiPolygon', 1, 0, 2, 1, 21, 20), (5, 'MultiPolygon', 1, 0, 2, 2, 20, 21), (5, 'MultiPolygon', 1, 0, 2, 3, 20, 20), (6, 'GeometryCollection', 0, 0, 0, 0, 0, 0), (6, 'GeometryCollection', 1, 0, 1, 0, 0, 0), (6, 'GeometryCollection', 1, 0, 1, 1, 3, 1))
 SELECT fid, geom_type, CAST(member AS INT) AS member, CAST(ring AS INT) AS ring, CAST(part AS INT) AS part, CAST(seq AS INT) AS seq, x + dx AS x, y + dy AS y FROM k JOIN v ON v.kind = k.kind""")
def geometry_types(spark, sf):
    """Features of all seven types, written as a feature collection and read back as one vertex table."""
    s = Tables(spark, sf).raw("supplier")
    x, y = F.pmod("s_suppkey", F.lit(10)).cast("double"), F.floor(F.col("s_suppkey") / 10).cast("double")

    def text(shape) -> Column:
        """A nested list of offsets as JSON coordinates."""
        if isinstance(shape, tuple):
            return F.format_string("[%s,%s]", (x + shape[0]).cast("string"), (y + shape[1]).cast("string"))
        return F.concat(F.lit("["), F.concat_ws(",", *[text(p) for p in shape]), F.lit("]"))

    ring, hole, far, line = [(0, 0), (9, 0), (0, 9), (0, 0)], [(1, 1), (2, 1), (1, 2), (1, 1)], [(20, 20), (21, 20), (20, 21), (20, 20)], [(0, 0), (3, 1)]
    shapes = [("Point", (0, 0)), ("MultiPoint", [(0, 0), (1, 2)]), ("LineString", line), ("MultiLineString", [line, [(1, 1), (0, 4)]]), ("Polygon", [ring, hole]), ("MultiPolygon", [[ring, hole], [far]])]
    simple = [F.concat(F.lit(f'{{"type":"{n}","coordinates":'), text(c), F.lit("}")) for n, c in shapes]
    both = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), simple[0], F.lit(","), simple[2], F.lit("]}"))
    geometry = F.element_at(F.array(*simple, both), (F.pmod("s_suppkey", F.lit(7)) + 1).cast("int"))
    path = scratch_path(spark, "features")
    s.select(F.format_string('{"features":[{"properties":{"id":%d},"geometry":%s}]}', "s_suppkey", geometry)).write.text(path)
    return I.vertices(I.read_features(spark, path, "id bigint"), "id")


@query("daily_files", "A4 A5", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id AS station, count(*) AS n, round(sum(value), 4) AS mm, CAST(0 AS BIGINT) AS bad FROM events GROUP BY 1, 2")
def daily_files(spark, sf):
    path = scratch_path(spark, "daily")
    e = Tables(spark, sf).raw("events").select(F.col("user_id").alias("station"), F.col("value").alias("mm"), F.date_format("ts", "yyyyMMdd").alias("d"))
    e.write.partitionBy("d").option("header", True).csv(path)
    d = I.load_daily(spark, path, "station bigint, mm double", r"d=(\d{8})")
    return d.groupBy("day", "station").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("mm"), "mm", 4), F.sum("bad").alias("bad")).select(txt("day"), "station", "n", "mm", "bad")


@query("bad_daily_rows", "A4", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1")
def bad_daily_rows(spark, sf):
    path = scratch_path(spark, "daily")
    mm = F.when(F.col("event_type") == "error", F.lit("no reading")).otherwise(F.col("value").cast("string"))
    e = Tables(spark, sf).raw("events").select(F.col("user_id").alias("station"), mm.alias("mm"), F.date_format("ts", "yyyyMMdd").alias("d"))
    e.write.partitionBy("d").option("header", True).csv(path)
    d = I.load_daily(spark, path, "station bigint, mm double", r"d=(\d{8})")
    return d.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad")).select(txt("day"), "n", "bad")


@query("north_up_rows", "A5", twin("SELECT station, CAST(floor((30.0e0 - lat) / 0.3e0) AS INT) AS row FROM stations", "stations"))
def north_up_rows(spark, sf):
    return Tables(spark, sf).stations().select("station", I.north_up_row(F.col("lat"), F.lit(30.0), 0.3).alias("row"))


@query("climate_index_file", "A6", twin("SELECT CAST(year AS INT) AS year, CAST(month AS INT) AS month, oni FROM oni", "oni"))
def climate_index_file(spark, sf):
    path = scratch_path(spark, "oni")
    seasons = F.array(*[F.lit(s) for s in I.SEASON_MIDDLE_MONTH])
    o = Tables(spark, sf).oni()
    line = F.format_string("  %s  %d   26.50  %5.2f", F.element_at(seasons, F.col("month")), F.col("year"), F.col("oni"))
    noise = o.select(F.format_string("SEAS YR TOTAL of %d", F.col("year")).alias("value")).distinct()
    o.select(line.alias("value")).unionByName(noise).write.text(path)
    return I.load_oni(spark, path)


@query("columnar_points", "A7", twin("SELECT station, lat, lon FROM stations", "stations"))
def columnar_points(spark, sf):
    path = scratch_path(spark, "points")
    s = Tables(spark, sf).stations()
    g = s.groupBy(F.floor(F.col("station") / 50)).agg(F.sort_array(F.collect_list(F.struct("station", "lat", "lon"))).alias("a"))
    g.select(F.col("a.station").alias("station"), F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon")).write.json(path)
    return I.load_points(spark, path)


@query("forecast_responses", "A8", twin("SELECT station, CAST(day AS VARCHAR) AS day, CASE WHEN mm > 40 THEN 0.0 ELSE mm END AS mm FROM rain_obs", "rain_obs"))
def forecast_responses(spark, sf):
    path = scratch_path(spark, "responses")
    o = Tables(spark, sf).rain_obs().withColumn("mm", F.when(F.col("mm") <= 40, F.col("mm")))
    g = o.groupBy("station", F.date_trunc("month", "day").alias("m")).agg(F.sort_array(F.collect_list(F.struct(F.col("day").cast("string").alias("time"), F.col("mm").alias("precipitation_sum")))).alias("d"))
    daily = F.struct(F.col("d.time").alias("time"), F.col("d.precipitation_sum").alias("precipitation_sum"))
    g.select("station", F.to_json(F.struct("station", daily.alias("daily")), {"ignoreNullFields": "false"}).alias("value")).select("value").write.text(path)
    return I.read_forecasts(spark, path).select("station", txt("day"), "mm")


@query("concatenated_batches", "A9", """SELECT station, CAST(day AS VARCHAR) AS day, arg_min(mm, batch) AS mm, min(batch) AS batch FROM (
 SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS mm, 0 AS batch FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 UNION ALL SELECT l_suppkey, CAST(l_shipdate AS DATE), sum(l_quantity), 1 FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2""")
def concatenated_batches(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    a = R.daily_totals(li.where("l_returnflag = 'R'"), "l_suppkey", "l_shipdate", "l_quantity")
    b = R.daily_totals(li, "l_suppkey", "l_shipdate", "l_quantity")
    return I.concat_batches([a, b]).select("station", txt("day"), "mm", "batch")


@query("deduplicated_pages", "A10", "SELECT count(*) AS n, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS removed FROM documents")
def deduplicated_pages(spark, sf):
    d = Tables(spark, sf).raw("documents").select("doc_id", "text")
    # a 32-byte digest is shuffled in place of the whole text
    keyed = d.select("doc_id", F.sha2("text", 256).alias("digest"))
    return I.removed_count(keyed, I.dedupe_first(keyed, ["digest"], [F.col("doc_id")]))


@query("first_order_lines", "A10", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def first_order_lines(spark, sf):
    li = Tables(spark, sf).raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return I.dedupe_first(li, ["l_orderkey", "l_linenumber"], [F.col("l_partkey")])


@query("harvest_union", "A11", "SELECT coalesce(CAST(nullif(l_linenumber, 2) AS VARCHAR), CAST(l_suppkey + 100000 AS VARCHAR)) AS feature_id, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def harvest_union(spark, sf):
    li = Tables(spark, sf).raw("lineitem").select(F.nullif(F.col("l_linenumber"), F.lit(2)).alias("id"), (F.col("l_suppkey") + 100000).alias("slide_no"), "l_partkey")
    return I.harvest_union(li, ["id", "slide_no"], [F.col("l_partkey")]).select("feature_id", "l_partkey")


@query("nearly_full_tiles", "A11", "SELECT l_suppkey AS tile, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 0.9 * 650")
def nearly_full_tiles(spark, sf):
    return I.nearly_full_tiles(Tables(spark, sf).raw("lineitem").select(F.col("l_suppkey").alias("tile")), "tile", 650)


@query("missing_days_by_year", "A12 K4 H9", "SELECT CAST(year(day) AS INT) AS year, count(*) AS missing FROM (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS day) WHERE day NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY 1")
def missing_days_by_year(spark, sf):
    days = Tables(spark, sf).raw("lineitem").select(F.to_date("l_shipdate").alias("day"))
    m = I.missing_days(days, F.lit("1994-01-01").cast("date"), F.lit("2002-12-31").cast("date"))
    return m.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("missing"))


@query("preferred_versions", "A13", "SELECT l_suppkey AS station, arg_min(l_returnflag, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS version FROM lineitem GROUP BY 1")
def preferred_versions(spark, sf):
    li = Tables(spark, sf).raw("lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_returnflag").alias("version"))
    return I.prefer_version(li, ["station"], "version", ["R", "A"])


@query("osm_rows", "A15", "SELECT fid, CASE WHEN n <= 1 THEN 'point' WHEN n >= 4 AND a = b THEN 'polygon' ELSE 'line' END AS kind, (l < 200)::INT AS tags FROM (SELECT doc_id AS fid, CAST(n_chars % 7 AS INT) AS n, 1 AS a, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE CAST(n_chars % 7 AS INT) END AS b, length(text) AS l FROM documents)")
def osm_rows(spark, sf):
    d = Tables(spark, sf).raw("documents")
    n = F.pmod(F.col("n_chars"), F.lit(7)).cast("int")
    base = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    nodes = F.when((n >= 2) & (F.pmod(F.col("n_chars"), F.lit(2)) == 0), F.concat(F.slice(base, 1, n - 1), F.array(F.lit(1)))).otherwise(base)
    tags = I.prune_tags(F.create_map(F.lit("note"), F.col("text")), longest=200)
    return d.select(F.col("doc_id").alias("fid"), I.geometry_kind(nodes).alias("kind"), F.size(F.map_keys(tags)).alias("tags"))


@query("dropped_noise", "A16", "SELECT s_suppkey, s_name FROM supplier")
def dropped_noise(spark, sf):
    s = Tables(spark, sf).raw("supplier").withColumn("OBJECTID", F.col("s_suppkey")).withColumn("Shape_Area", F.col("s_acctbal"))
    return I.drop_noise(s, ["s_nationkey", "s_acctbal"])


@query("provenance_manifest", "A17", None)
def provenance_manifest(spark, sf):
    new = I.file_manifest(spark, sf, "tables")
    old = new.where(F.col("name").startswith("p")).withColumn("bytes", F.lit(0).cast("long"))
    other = new.where(F.col("name").startswith("n")).withColumn("source", F.lit("other"))
    return I.upsert_manifest(old.unionByName(other), new)


@query("file_heads", "A17", """SELECT s_suppkey % 5 AS folder, count(*) AS files, CAST(sum(strlen(s_name || ' ' || s_acctbal) + 1) AS BIGINT) AS bytes, string_agg(sha256(substring(s_name || ' ' || s_acctbal, 1, 12))[:16], ',' ORDER BY sha256(substring(s_name || ' ' || s_acctbal, 1, 12))) AS heads
 FROM supplier GROUP BY 1""")
def file_heads(spark, sf):
    """A file per supplier in five folders; hashes are of the first twelve bytes of each."""
    s = Tables(spark, sf).raw("supplier")
    path = scratch_path(spark, "delivered")
    line = F.concat("s_name", F.lit(" "), F.col("s_acctbal").cast("string")).alias("value")
    K.write_each(s.select(F.pmod("s_suppkey", F.lit(5)).alias("folder"), line), path, "folder", "value")
    f = I.file_heads(spark, path, "part-*", head=12)
    folder = F.regexp_extract("path", r"folder=(\d+)", 1).cast("bigint").alias("folder")
    return f.groupBy(folder).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
                                 F.concat_ws(",", F.transform(F.sort_array(F.collect_list("sha256_head")), lambda h: F.substring(h, 1, 16))).alias("heads"))


PRV = {"f": "SELECT 'layer_' || p_partkey || CASE WHEN p_size > 25 THEN '-clipped.tif' ELSE '.tif' END AS name FROM part", "m": "SELECT 'layer_' || p_partkey || '.tif' AS name, p_brand AS source FROM part WHERE p_retailprice > 920"}


def provenance(t: Tables):
    p = t.raw("part")
    files = p.select(F.concat(F.lit("layer_"), F.col("p_partkey"), F.when(F.col("p_size") > 25, "-clipped.tif").otherwise(".tif")).alias("name"))
    man = p.where("p_retailprice > 920").select(F.concat(F.lit("layer_"), F.col("p_partkey"), F.lit(".tif")).alias("name"), F.col("p_brand").alias("source"))
    return files, man


@query("attached_provenance", "A18", f"WITH f AS ({PRV['f']}), m AS ({PRV['m']}) SELECT f.name, m.source FROM f LEFT JOIN m ON m.name = replace(f.name, '-clipped', '')")
def attached_provenance(spark, sf):
    return I.attach_provenance(*provenance(Tables(spark, sf))).select("name", "source")


@query("unrecorded_files", "A18 H9", f"WITH f AS ({PRV['f']}), m AS ({PRV['m']}) SELECT f.name FROM f WHERE replace(f.name, '-clipped', '') NOT IN (SELECT name FROM m)")
def unrecorded_files(spark, sf):
    return I.unrecorded(*provenance(Tables(spark, sf))).select("name")


@query("csv_export", "A19", twin("SELECT road_id, sum(km) AS km FROM pieces WHERE cls >= 4 GROUP BY 1", "pieces"))
def csv_export(spark, sf):
    path = scratch_path(spark, "csv")
    p = Tables(spark, sf).pieces().where("cls >= 4").groupBy("road_id").agg(F.sum("km").alias("km"))
    K.to_csv(p, path)
    return spark.read.schema("road_id bigint, km double").option("header", True).csv(path)


@query("json_report", "A20", twin("SELECT count(*) AS station_days, round(avg(trigger), 6) AS mean_trigger, count(*) FILTER (WHERE trigger >= 0.9e0) AS alerts FROM trig", "trig"))
def json_report(spark, sf):
    path = scratch_path(spark, "report")
    t = Se.season_trigger(Tables(spark, sf).readings())
    K.to_report(t.agg(F.count(F.lit(1)).alias("station_days"), r6(F.avg("trigger"), "mean_trigger"), F.count_if(F.col("trigger") >= 0.9).alias("alerts")), path)
    return spark.read.schema("station_days bigint, mean_trigger double, alerts bigint").json(path)


@query("compact_points", "A22", twin("SELECT fid, round(cx, 4) AS lon, round(cy, 4) AS lat, CASE WHEN fid < 10 THEN 'near' ELSE 'far' END AS src FROM (SELECT s_suppkey AS fid, 10.0e0 * (s_suppkey % 10) + 4.25e0 AS cx, 10.0e0 * (s_suppkey // 10) + 4.25e0 AS cy FROM supplier)"))
def compact_points(spark, sf):
    from ..operators.spatial import geometry_measures
    g = geometry_measures(Tables(spark, sf).verts())
    x = K.export_points(g, "cx", "cy", F.struct("fid", F.when(F.col("fid") < 10, "near").otherwise("far").alias("t")))
    return x.select("src.fid", "lon", "lat", F.col("src.t").alias("src"))


@query("source_tags", "A22 K6", "SELECT p_brand, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'one' WHEN starts_with(p_brand, 'Brand#2') THEN 'two' ELSE 'other' END AS tag, count(*) AS n FROM part GROUP BY 1, 2")
def source_tags(spark, sf):
    p = Tables(spark, sf).raw("part")
    return p.groupBy("p_brand", K.prefix_tag(F.col("p_brand"), {"Brand#1": "one", "Brand#2": "two"}, "other").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("tile_names", "A23", twin("SELECT station, format('N{:02d}E{:03d}', CAST(floor(lat / 3) * 3 AS INT), CAST(floor(lon / 3) * 3 AS INT)) AS tile FROM stations", "stations"))
def tile_names(spark, sf):
    return Tables(spark, sf).stations().select("station", L.tile_name(F.col("lat"), F.col("lon"), 3).alias("tile"))


@query("absent_tiles", "A23 H9", twin("SELECT CAST(la AS INT) AS lat, CAST(lo AS INT) AS lon FROM (SELECT unnest(range(24, 34, 3)) AS la), (SELECT unnest(range(90, 103, 3)) AS lo) WHERE (la, lo) NOT IN (SELECT (CAST(floor(lat / 3) * 3 AS BIGINT), CAST(floor(lon / 3) * 3 AS BIGINT)) FROM stations)", "stations"))
def absent_tiles(spark, sf):
    have = Tables(spark, sf).stations().select((F.floor(F.col("lat") / 3) * 3).cast("int").alias("lat"), (F.floor(F.col("lon") / 3) * 3).cast("int").alias("lon")).distinct()
    return I.tiles_for_bbox(spark, 91, 26, 102, 33, 3).join(have, ["lat", "lon"], "left_anti")


@query("validated_layers", "C11 A1 I8", twin("SELECT count(*) AS n, count(elev) AS elev, CAST(min(fold) AS INT) AS first_fold, CAST(max(fold) AS INT) AS last_fold FROM (SELECT elev, col % 5 AS fold FROM cells)", "cells"))
def validated_layers(spark, sf):
    c = folded(Tables(spark, sf))
    c = c.select(*O.ordered_columns(c))
    return c.agg(F.count(F.lit(1)).alias("n"), F.count("elev").alias("elev"), F.min("fold").alias("first_fold"), F.max("fold").alias("last_fold"))
