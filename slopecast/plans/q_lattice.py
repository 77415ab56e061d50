"""Lattice queries: ids, projections, resampling, assembly, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE_GRID, LANDSLIDE_BREAKS, WebGrid
from ..functions import classify as C
from ..functions import lattice as L
from ..functions import quantise as Qz
from ..operators import aggregates as A
from ..operators import lattice as O
from ..operators import rain as R
from ..operators.ranking import percentiles
from .fixtures import Tables
from .q_rain import r6, txt
from .registry import query
from .twins import twin

WEB = WebGrid(west=92.0, south=27.0, east=92.4, north=27.4, width=80, height=60)


@query("cell_codes", "B1 B2 B3 B4 B5", twin("""SELECT cell_id, CAST(floor(cell_id / 100000) AS INT) AS row_back, CAST(cell_id % 100000 AS INT) AS col_back,
 (col + 0.5e0) * 100.0e0 AS x, 0.0e0 - (row + 0.5e0) * 100.0e0 AS y, row AS row_xy, col AS col_xy,
 CAST(row // 10 AS BIGINT) * 100000 + col // 10 AS block FROM cells""", "cells"))
def cell_codes(spark, sf):
    c = Tables(spark, sf).cells()
    g = FIXTURE_GRID
    xy = c.withColumn("x", L.centre_x(F.col("col"), g)).withColumn("y", L.centre_y(F.col("row"), g))
    return xy.select(
        "cell_id", L.decode_row(F.col("cell_id")).alias("row_back"), L.decode_col(F.col("cell_id")).alias("col_back"),
        "x", "y", L.row_of(F.col("y"), g).alias("row_xy"), L.col_of(F.col("x"), g).alias("col_xy"),
        L.block_id(F.col("row"), F.col("col"), 10).cast("long").alias("block"),
    )


@query("points_in_grid", "B4 H3", twin("""SELECT count(*) AS n, count(*) FILTER (WHERE r BETWEEN 0 AND 3199 AND c BETWEEN 0 AND 5899) AS inside FROM
 (SELECT CAST(floor((0.0e0 - y) / 100.0e0) AS INT) AS r, CAST(floor(x / 100.0e0) AS INT) AS c FROM (SELECT l_extendedprice * 10 AS x, 0.0e0 - (l_quantity - 10) * 1000 AS y FROM lineitem))"""))
def points_in_grid(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    x, y = F.col("l_extendedprice") * 10, -(F.col("l_quantity") - 10) * 1000
    r, c = L.row_of(y, FIXTURE_GRID), L.col_of(x, FIXTURE_GRID)
    return li.agg(F.count(F.lit(1)).alias("n"), F.count_if(L.in_grid(r, c, FIXTURE_GRID)).alias("inside"))


WEBSQL = {"px": """SELECT place_id, lat, lon, CAST(trunc((27.4e0 - lat) / (27.4e0 - 27.0e0) * 60) AS INT) AS r, CAST(trunc((lon - 92.0e0) / (92.4e0 - 92.0e0) * 80) AS INT) AS c FROM places"""}


@query("web_pixels", "B6 B7", twin("""SELECT place_id, CASE WHEN ok THEN least(r, 59) END AS row, CASE WHEN ok THEN least(c, 79) END AS col,
 r AS row_open, c AS col_open, CASE WHEN r BETWEEN 0 AND 59 AND c BETWEEN 0 AND 79 THEN 1 ELSE 0 END AS in_bounds
 FROM (SELECT *, lat BETWEEN 27.0e0 AND 27.4e0 AND lon BETWEEN 92.0e0 AND 92.4e0 AS ok FROM px)""", "places", extra=WEBSQL))
def web_pixels(spark, sf):
    p = Tables(spark, sf).places()
    r, c = L.web_pixel(F.col("lat"), F.col("lon"), WEB)
    ro, co, ok = L.web_pixel_open(F.col("lat"), F.col("lon"), WEB)
    return p.select("place_id", r.alias("row"), c.alias("col"), ro.alias("row_open"), co.alias("col_open"), ok.cast("int").alias("in_bounds"))


@query("web_axes", "B8", twin("""SELECT row, col, round(lat, 6) AS lat, round(92.0e0 + (col + 0.5e0) * 0.005e0, 6) AS lon,
 round(0.4e0 / 80 * 111.0e0 * cos(radians(lat)), 6) AS width_km FROM (SELECT row, col, 27.4e0 - (row + 0.5e0) * (0.4e0 / 60) AS lat FROM cells)""", "cells"))
def web_axes(spark, sf):
    lat = L.web_centre_lat(F.col("row"), WEB)
    return Tables(spark, sf).cells().select(
        "row", "col", r6(lat, "lat"), r6(L.web_centre_lon(F.col("col"), WEB), "lon"), r6(L.web_cell_width_km(lat, WEB), "width_km")
    )


@query("flat_distances", "B9 B10", twin("""SELECT place_id, round(sqrt(pow((lat - 27.1e0) * 110.6e0, 2) + pow((lon - 92.1e0) * 98.9e0, 2)), 6) AS local_km,
 round(sqrt(pow(lat - 27.1e0, 2) + pow((lon - 92.1e0) * 0.89e0, 2)) * 111.0e0, 6) AS shrunk_km,
 round(sqrt(pow(lat - 27.1e0, 2) + pow((lon - 92.1e0) * cos(radians(lat)), 2)), 6) AS cos_deg,
 CASE WHEN lat BETWEEN 26.9e0 AND 27.5e0 AND lon BETWEEN 91.9e0 AND 92.5e0 THEN 1 ELSE 0 END AS nearby FROM places""", "places"))
def flat_distances(spark, sf):
    la, lo = F.lit(27.1), F.lit(92.1)
    a, o = F.col("lat"), F.col("lon")
    return Tables(spark, sf).places().select(
        "place_id", r6(L.km_local(a, o, la, lo), "local_km"), r6(L.km_shrunk(a, o, la, lo), "shrunk_km"),
        r6(L.degrees_cos(a, o, la, lo), "cos_deg"), L.in_area(a, o, WebGrid(92.0, 27.0, 92.4, 27.4, 80, 60), 0.1).cast("int").alias("nearby"),
    )


@query("mercator_to_degrees", "B11", """SELECT o_orderkey, round(degrees(o_totalprice * 50 / 6378137.0e0), 6) AS lon,
 round(degrees(2 * atan(exp(o_totalprice * 20 / 6378137.0e0)) - pi() / 2), 6) + 0.0e0 AS lat FROM orders""")
def mercator_to_degrees(spark, sf):
    o = Tables(spark, sf).raw("orders")
    return o.select("o_orderkey", r6(L.lon_from_mercator(F.col("o_totalprice") * 50), "lon"), r6(L.lat_from_mercator(F.col("o_totalprice") * 20), "lat"))


@query("aoi_overlap", "B12", twin("""SELECT fid, round(100.0e0 * greatest(0, least(e, 30) - greatest(w, 5)) * greatest(0, least(n, 30) - greatest(s, 5)) / (25.0e0 * 25.0e0), 6) AS pct
 FROM (SELECT fid, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM verts GROUP BY fid)""", "verts"))
def aoi_overlap(spark, sf):
    b = Tables(spark, sf).verts().groupBy("fid").agg(F.min("x").alias("w"), F.min("y").alias("s"), F.max("x").alias("e"), F.max("y").alias("n"))
    return b.select("fid", r6(L.overlap_percent(F.col("w"), F.col("s"), F.col("e"), F.col("n"), (5.0, 5.0, 30.0, 30.0)), "pct"))


@query("unit_conversions", "B14", """SELECT p_partkey, round(p_retailprice / 10.0e0, 6) AS pct, round(p_retailprice - 273.15e0, 6) AS celsius,
 round(p_size * 0.01e0, 6) AS km2, round(p_retailprice / 1000.0e0, 6) AS km FROM part""")
def unit_conversions(spark, sf):
    v = F.col("p_retailprice")
    return Tables(spark, sf).raw("part").select(
        "p_partkey", r6(Qz.per_mille_to_percent(v), "pct"), r6(Qz.kelvin_to_celsius(v), "celsius"),
        r6(Qz.cells_to_km2(F.col("p_size")), "km2"), r6(Qz.metres_to_km(v), "km"),
    )


@query("block_reduce", "C1 C6 D5", twin("""SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(elev), 6) AS mean, max(elev) AS max, min(elev) AS min,
 round(sum(elev), 6) AS sum, round(max(elev) - min(elev), 6) AS relief FROM cells GROUP BY 1, 2""", "cells"))
def block_reduce(spark, sf):
    d = O.to_display(Tables(spark, sf).cells(), "elev", 4)
    return d.select("row", "col", r6("mean"), "max", "min", r6("sum"), r6(F.col("max") - F.col("min"), "relief"))


@query("circular_mean", "C2", twin("""SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(cos(radians(elev))), 6) + 0.0e0 AS northness,
 round(avg(sin(radians(elev))), 6) + 0.0e0 AS eastness FROM cells GROUP BY 1, 2""", "cells"))
def circular_mean(spark, sf):
    d = O.circular_mean(Tables(spark, sf).cells(), "elev", 4)
    return d.select("row", "col", r6("northness"), r6("eastness"))


@query("block_mode", "C3", twin("""SELECT row, col, lc FROM (SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, lc,
 row_number() OVER (PARTITION BY row // 4, col // 4 ORDER BY count(*) DESC, lc) AS k FROM cells GROUP BY row // 4, col // 4, lc) WHERE k = 1""", "cells"))
def block_mode(spark, sf):
    return O.block_mode(Tables(spark, sf).cells(), "lc", 4)


@query("bilinear_sample", "C4", twin("""SELECT f.cell_id, round(sum(w * c.elev) / sum(w), 6) AS coarse_elev FROM (
 SELECT cell_id, r0 + a AS r, c0 + b AS c, (CASE WHEN a = 1 THEN fr ELSE 1 - fr END) * (CASE WHEN b = 1 THEN fc ELSE 1 - fc END) AS w FROM (
  SELECT cell_id, CAST(floor((row + 0.5e0) / 4 - 0.5e0) AS INT) AS r0, CAST(floor((col + 0.5e0) / 4 - 0.5e0) AS INT) AS c0,
   (row + 0.5e0) / 4 - 0.5e0 - floor((row + 0.5e0) / 4 - 0.5e0) AS fr, (col + 0.5e0) / 4 - 0.5e0 - floor((col + 0.5e0) / 4 - 0.5e0) AS fc FROM cells),
  (VALUES (0,0),(0,1),(1,0),(1,1)) o(a, b)) f
 JOIN (SELECT row // 4 AS row, col // 4 AS col, avg(elev) AS elev FROM cells GROUP BY 1, 2) c ON c.row = f.r AND c.col = f.c GROUP BY 1""", "cells"))
def bilinear_sample(spark, sf):
    c = Tables(spark, sf).cells()
    coarse = O.block_reduce(c, "elev", 4)
    return O.bilinear(coarse, c.select("cell_id", "row", "col"), "elev", 4).select("cell_id", r6("elev", "coarse_elev"))


@query("nearest_sample", "C5", twin("""SELECT c.cell_id, k.lc AS coarse_lc FROM cells c LEFT JOIN (SELECT row // 5 AS r, col // 5 AS q, max(lc) AS lc FROM cells GROUP BY 1, 2) k
 ON c.row // 5 = k.r AND c.col // 5 = k.q""", "cells"))
def nearest_sample(spark, sf):
    c = Tables(spark, sf).cells()
    coarse = O.block_reduce(c, "lc", 5, "max").withColumnRenamed("lc", "coarse_lc")
    return O.nearest_sample(coarse, c.select("cell_id", "row", "col"), "coarse_lc", 5).select("cell_id", "coarse_lc")


@query("flag_share", "C7", twin("""SELECT CAST(row // 6 AS INT) AS row, CAST(col // 6 AS INT) AS col, round(avg(f), 6) AS share, CASE WHEN avg(f) >= 0.05e0 THEN 1 ELSE 0 END AS kept
 FROM (SELECT row, col, CASE WHEN elev > 1700 THEN 1.0e0 ELSE 0.0e0 END AS f FROM cells) GROUP BY 1, 2""", "cells"))
def flag_share(spark, sf):
    return O.flag_share(Tables(spark, sf).cells(), F.col("elev") > 1700, 6).select("row", "col", r6("share"), "kept")


@query("mosaic_tiles", "C8", twin("""SELECT cell_id, v FROM (SELECT cell_id, l_quantity AS v, row_number() OVER (PARTITION BY cell_id
 ORDER BY l_orderkey * 100 + l_linenumber DESC, l_quantity DESC) AS k FROM (SELECT cell_id, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM pc WHERE l_discount > 0 GROUP BY 1, 2, 3)) WHERE k = 1""", "pc"))
def mosaic_tiles(spark, sf):
    pc = Tables(spark, sf)._part_cells()
    tiles = pc.select("cell_id", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"), F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("v"))
    best = tiles.groupBy("cell_id", "o").agg(F.max("v").alias("v"))
    return O.mosaic(best, ["cell_id"], "v", "o")


@query("decimate_and_stack", "C9", twin("""SELECT CAST(row AS INT) AS row, col, elev FROM (SELECT row, col, elev FROM cells WHERE row % 5 = 0 AND col % 5 = 0
 UNION ALL SELECT row + (SELECT max(row) + 1 FROM cells), col, elev FROM cells WHERE row % 5 = 0 AND col % 5 = 0)""", "cells"))
def decimate_and_stack(spark, sf):
    c = Tables(spark, sf).cells().select("row", "col", "elev")
    d = O.decimate(c, 5)
    below = d.withColumn("_h", c.agg((F.max("row") + 1).alias("h")).scalar())
    return O.stack_strips(d.withColumn("_h", F.lit(0)), below, F.col("_h")).drop("_h")


@query("mask_to_region", "C10", twin("SELECT cell_id, CASE WHEN cell_id IN (SELECT cell_id FROM flags) THEN elev END AS elev FROM cells", "cells", "flags"))
def mask_to_region(spark, sf):
    t = Tables(spark, sf)
    return O.mask_to(t.cells().select("cell_id", "elev"), t.flags(), "elev")


@query("assemble_cell_table", "C11 C14", twin("""SELECT c.cell_id, c.row, c.col, round(CAST(max(l_quantity) AS DOUBLE), 3) AS rain_peak, round(CAST(CAST(avg(l_extendedprice) AS FLOAT) AS DOUBLE), 0) AS terrain_mean, count(l_partkey) AS n
 FROM cells c LEFT JOIN pc USING (cell_id) GROUP BY 1, 2, 3""", "cells", "pc"))
def assemble_cell_table(spark, sf):
    t = Tables(spark, sf)
    pc = t._part_cells().groupBy("cell_id").agg(F.max("l_quantity").alias("rain_peak"), F.avg("l_extendedprice").alias("terrain_mean"), F.count(F.lit(1)).cast("double").alias("n"))
    layers = pc.unpivot(["cell_id"], ["rain_peak", "terrain_mean", "n"], "layer", "value")
    wide = O.assemble(t.cells().select("cell_id", "row", "col"), layers, ["terrain_mean", "rain_peak", "n"])
    wide = wide.select(*O.ordered_columns(wide))
    return wide.withColumn("rain_peak", r6(F.col("rain_peak").cast("double"), n=3, name="x")).withColumn(
        "terrain_mean", F.round(F.col("terrain_mean").cast("double"), 0)).withColumn("n", F.coalesce(F.col("n").cast("long"), F.lit(0)))


@query("typed_cell_table", "C11", twin("""SELECT CAST(cell_id AS INT) AS cell_id, CAST(row AS SMALLINT) AS row, CAST(col AS SMALLINT) AS col, CAST(lc AS SMALLINT) AS lc_class_cat, round(CAST(CAST(elev AS FLOAT) AS DOUBLE), 2) AS terrain_elev,
 'int smallint smallint smallint float' AS types FROM cells""", "cells"))
def typed_cell_table(spark, sf):
    """Category codes stay whole numbers, measures are FLOAT, keys as narrow as they can be."""
    c = Tables(spark, sf).cells().withColumn("lc", F.col("lc").cast("double"))
    layers = c.select("cell_id", F.col("lc").alias("lc_class_cat"), F.col("elev").alias("terrain_elev")).unpivot(["cell_id"], ["lc_class_cat", "terrain_elev"], "layer", "value")
    wide = O.compact_keys(O.assemble(c.select("cell_id", "row", "col"), layers, ["lc_class_cat", "terrain_elev"], categories=["lc_class_cat"]))
    wide = wide.select(*O.ordered_columns(wide)).withColumn("types", F.lit(" ".join(t for _, t in wide.select(*O.ordered_columns(wide)).dtypes)))
    return wide.withColumn("terrain_elev", F.round(F.col("terrain_elev").cast("double"), 2))


@query("dilate_points", "C13", twin("""SELECT CAST(row + a AS INT) AS row, CAST(col + b AS INT) AS col, arg_max(elev, cell_id) AS elev FROM cells, (VALUES (-1),(0),(1)) x(a), (VALUES (-1),(0),(1)) y(b)
 WHERE cell_id IN (SELECT cell_id FROM flags) GROUP BY 1, 2""", "cells", "flags"))
def dilate_points(spark, sf):
    t = Tables(spark, sf)
    pts = t.cells().join(t.flags().select("cell_id"), "cell_id", "left_semi")
    return O.dilate(pts, "elev", "cell_id")


@query("modelling_domain", "G1", twin("SELECT cell_id, slope, lc FROM cells WHERE lc NOT IN (70, 80, 100) AND slope > 10", "cells"))
def modelling_domain(spark, sf):
    return O.domain_filter(Tables(spark, sf).cells()).select("cell_id", "slope", "lc")


@query("season_filter", "G2", twin("SELECT event_id, CAST(day AS VARCHAR) AS day FROM ev WHERE month(day) BETWEEN 5 AND 10", "ev"))
def season_filter(spark, sf):
    return Tables(spark, sf).events().where(C.in_season(F.col("day"))).select("event_id", txt("day"))


@query("valid_in_bbox", "G3", twin("""SELECT place_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM places JOIN cells ON partkey = place_id WHERE lat BETWEEN 27.05e0 AND 27.3e0 AND lon BETWEEN 92.1e0 AND 92.3e0 AND elev <> 1100 AND NOT isnan(elev)""", "places", "cells"))
def valid_in_bbox(spark, sf):
    c = Tables(spark, sf).cells().select(F.col("partkey").alias("place_id"), (F.lit(27.0) + F.col("row") * 0.01).alias("lat"), (F.lit(92.0) + F.col("col") * 0.01).alias("lon"), "elev")
    ok = F.col("lat").between(27.05, 27.3) & F.col("lon").between(92.1, 92.3) & (F.col("elev") != 1100) & ~F.isnan("elev")
    return c.where(ok).select("place_id", r6("lat"), r6("lon"))


@query("alpha_mask", "G4", "SELECT l_returnflag AS flag, sum(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END)::BIGINT AS opaque FROM lineitem GROUP BY 1")
def alpha_mask(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(C.alpha_mask(F.col("l_discount"))).alias("opaque"))


@query("classify_breaks", "G5", twin("""SELECT CAST(CASE WHEN v IS NULL THEN 0 ELSE 1 + (v >= 0.02e0)::INT + (v >= 0.06e0)::INT + (v >= 0.15e0)::INT + (v >= 0.30e0)::INT END AS INT) AS cls,
 CAST(CASE WHEN v IS NULL OR v <= 0 THEN 0 ELSE 1 + (v >= 0.04e0)::INT + (v >= 0.10e0)::INT + (v >= 0.20e0)::INT + (v >= 0.33e0)::INT END AS INT) AS flood_cls, count(*) AS n
 FROM (SELECT CASE WHEN l_linenumber > 1 THEN l_quantity / 50.0e0 * l_discount * 5 END AS v FROM lineitem) GROUP BY 1, 2"""))
def classify_breaks(spark, sf):
    from ..config import FLOOD_HAZARD_BREAKS
    v = F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / 50.0 * F.col("l_discount") * 5)
    li = Tables(spark, sf).raw("lineitem").select(v.alias("v"))
    return li.groupBy(C.classify(F.col("v"), LANDSLIDE_BREAKS).alias("cls"), C.classify_positive(F.col("v"), FLOOD_HAZARD_BREAKS).alias("flood_cls")).agg(F.count(F.lit(1)).alias("n"))


@query("classify_percentiles", "G6", """WITH b AS (SELECT quantile_cont(p_retailprice, 0.5) AS b1, quantile_cont(p_retailprice, 0.75) AS b2, quantile_cont(p_retailprice, 0.9) AS b3, quantile_cont(p_retailprice, 0.97) AS b4 FROM part)
 SELECT CAST(1 + (p_retailprice >= b1)::INT + (p_retailprice >= b2)::INT + (p_retailprice >= b3)::INT + (p_retailprice >= b4)::INT AS INT) AS cls, count(*) AS n FROM part, b GROUP BY 1""")
def classify_percentiles(spark, sf):
    p = Tables(spark, sf).raw("part")
    cuts = percentiles(p, "p_retailprice", [0.5, 0.75, 0.9, 0.97]).select(F.struct("p0", "p1", "p2", "p3").alias("b")).scalar()
    x = p.select("p_retailprice").withColumn("b", cuts)
    cls = F.lit(1)
    for i in range(4):
        cls = cls + (F.col("p_retailprice") >= F.col(f"b.p{i}")).cast("int")
    return x.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("legend_join", "G7 H2", twin("""SELECT cell_id, CASE lc WHEN 10 THEN 'tree cover' WHEN 20 THEN 'shrubland' WHEN 30 THEN 'grassland' WHEN 40 THEN 'cropland' WHEN 50 THEN 'built-up' ELSE 'class ' || lc END AS name FROM cells""", "cells"))
def legend_join(spark, sf):
    from ..operators.tables import LANDCOVER_NAMES, with_legend
    names = {k: v for k, v in LANDCOVER_NAMES.items() if k <= 50}
    return with_legend(Tables(spark, sf).cells().select("cell_id", "lc"), "lc", names).select("cell_id", "name")


@query("lead_labels", "G8", twin("""SELECT CAST(date_diff('day', DATE '1998-03-01', day) AS INT) AS lead, CASE WHEN date_diff('day', DATE '1998-03-01', day) <= 3 THEN 'higher' ELSE 'lower' END AS confidence FROM cal WHERE day >= DATE '1998-03-01'""", "cal"))
def lead_labels(spark, sf):
    lead, conf = C.lead_label(F.lit("1998-03-01").cast("date"), F.col("day"))
    d = R.calendar(Tables(spark, sf).readings()).where(F.col("day") >= F.lit("1998-03-01").cast("date"))
    return d.select(lead.alias("lead"), conf.alias("confidence"))


@query("river_tiers", "G10", twin("SELECT basin, CASE WHEN sub_area * 40 >= 2000 THEN 'large' ELSE 'watch' END AS tier FROM basins", "basins"))
def river_tiers(spark, sf):
    return Tables(spark, sf).basins().select("basin", C.river_class(F.col("sub_area") * 40).alias("tier"))


@query("quantised_layers", "A21", twin("""SELECT cell_id, CAST(round_even(least(1.0e0, greatest(0.0e0, (elev - 900) / 1100.0e0)) * 254.0e0, 0) AS INT) AS u8,
 CAST(round_even(least(65534.0e0, greatest(0.0e0, elev)), 0) AS INT) AS u16, CAST(1 + round_even(least(1.0e0, greatest(0.0e0, (elev - 1000) / 500.0e0)) * 254.0e0, 0) AS INT) AS ranged,
 CAST(1 + round_even(least(1.0e0, greatest(0.0e0, sqrt(elev) / pow(2500.0e0, 0.5e0))) * 254.0e0, 0) AS INT) AS rooted,
 CAST(1 + round_even(least(1.0e0, greatest(0.0e0, log10(elev + 1.0e0) / 4.0e0)) * 254.0e0, 0) AS INT) AS logged FROM cells""", "cells"))
def quantised_layers(spark, sf):
    e = F.col("elev")
    return Tables(spark, sf).cells().select(
        "cell_id", Qz.u8_unit((e - 900) / 1100.0).cast("int").alias("u8"), Qz.u16_metres(e).alias("u16"),
        Qz.u8_ranged(e, 1000.0, 1500.0).cast("int").alias("ranged"), Qz.u8_sqrt(e, 2500.0).cast("int").alias("rooted"), Qz.u8_log(e, 4.0).cast("int").alias("logged"),
    )
