"""Exact overlay of points, lines and polygons: neighbours are found by tile, insides by parity.

A polygon is indexed by the tiles its boundary passes through. Each such tile knows the even-odd
parity of one of its corners, so a point is decided by the edges inside its own tile: walk from
the point to the tile's right border, then along the border to the corner, and count crossings.
Tiles between two boundary tiles of a row lie wholly inside or outside; inside ones are listed
without edges. The index has one entry per edge and tile it passes, and one per inner tile.

Polygons are vertex tables (fid, part, seq, x, y) of closed rings; insides are even-odd over all
rings of a feature. Points on a boundary belong to the side that ray casting to the right gives
them: an edge spans heights in [low, high), and a point on an edge lies to its right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import reused
from .spatial import edges

STRETCH = 512  # edges of a ring that one index entry holds at most,
RINGS = 64  # and rings
WITHIN_PIECE = 0.6180339887  # where a piece of a segment is tested: round shares fall on corners of round coordinates
ASIDE = 2.0**-50  # of its coordinates: how far left of a segment its inside is tested, some last places
PAD = 1e-9  # of a tile: a boundary on a tile border is listed on both sides of it


def _tile(c: Column, tile: float) -> Column:
    return F.floor(c / F.lit(tile)).cast("int")


def tiles_of_edges(e: DataFrame, tile: float) -> DataFrame:
    """``e`` (x1, y1, x2, y2, ...) once per tile that a segment touches, as ``tx``, ``ty``.

    Row by row, the columns between where the segment enters and leaves the row: entries grow
    with the length of a segment, not with its bounding box.
    """
    pad = F.lit(PAD * tile)
    ty = F.sequence(_tile(F.least("y1", "y2") - pad, tile), _tile(F.greatest("y1", "y2") + pad, tile))
    rows = e.withColumn("ty", F.explode(ty))
    lo = F.greatest(F.least("y1", "y2"), F.col("ty") * F.lit(tile))
    hi = F.least(F.greatest("y1", "y2"), (F.col("ty") + 1) * F.lit(tile))

    def x_at(y: Column, level: str) -> Column:
        x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
        return F.when(F.col("y1") == F.col("y2"), F.col(level)).otherwise(F.least(F.greatest(x, F.least("x1", "x2")), F.greatest("x1", "x2")))

    xa, xb = x_at(lo, "x1"), x_at(hi, "x2")
    tx = F.sequence(_tile(F.least(xa, xb) - pad, tile), _tile(F.greatest(xa, xb) + pad, tile))
    return rows.withColumn("tx", F.explode(tx))


def _x_of(e: Column, y: Column) -> Column:
    return e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])


def _left_of(e: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies left of an edge's line; of a level edge, below it."""
    return F.when(e["y1"] == e["y2"], e["y1"] > y).otherwise(x < _x_of(e, y))


def tile_index(verts: DataFrame, tile: float) -> DataFrame:
    """(fid, tx, ty, odd, edges): parity of a tile's lower right corner, and the boundary inside the tile.

    Boundary tiles have one entry per stretch of some rings in them, and one that carries the parity;
    inner tiles have one entry without edges and ``odd`` = 1. Outer tiles are not listed.
    """
    e = edges(verts)
    cut = tiles_of_edges(e, tile).groupBy("fid", "tx", "ty", F.floor(F.col("part") / RINGS).alias("_p"), F.floor(F.col("seq") / STRETCH).alias("_s")).agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    # where edges cross the lower border of a row of tiles; a crossing belongs to the tile (tx * tile, (tx + 1) * tile]
    slanted = e.where("y1 <> y2")
    first, last = F.ceil(F.least("y1", "y2") / tile).cast("int"), (F.ceil(F.greatest("y1", "y2") / tile) - 1).cast("int")
    rows = slanted.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("ty", F.explode(F.sequence("_a", "_b")))
    x = F.col("x1") + (F.col("ty") * F.lit(tile) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    k = F.ceil(F.col("_x") / tile).cast("int") - 1
    k = k + F.when((k + 1) * F.lit(tile) < F.col("_x"), 1).when(~(k * F.lit(tile) < F.col("_x")), -1).otherwise(0)
    crossed = rows.withColumn("_x", x).groupBy("fid", "ty", k.alias("tx")).agg(F.count(F.lit(1)).alias("_n"))
    known = crossed.unionByName(cut.select("fid", "ty", "tx", F.lit(0).cast("long").alias("_n")))
    per_tile = known.groupBy("fid", "ty", "tx").agg(F.sum("_n").alias("_n"))
    w = W.partitionBy("fid", "ty").orderBy(F.desc("tx"))
    right = F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    corners = per_tile.withColumn("odd", (right % 2).cast("int")).withColumn("_next", F.lag("tx").over(w))
    none = F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    boundary = cut.select("fid", "tx", "ty", F.lit(0).alias("odd"), "edges").unionByName(
        corners.where("odd = 1").select("fid", "tx", "ty", "odd", none.alias("edges")))
    gaps = corners.where("odd = 1 and _next > tx + 1").select(
        "fid", "ty", "odd", F.explode(F.sequence(F.col("tx") + 1, F.col("_next") - 1)).alias("tx"), none.alias("edges"))
    return boundary.unionByName(gaps)


def inside(points: DataFrame, verts: DataFrame, pid: str, tile: float) -> DataFrame:
    """(pid, fid) for every point (pid, x, y; ``pid`` names one point) inside a polygon of ``verts``."""
    px, py = F.col("_px"), F.col("_py")
    p = points.select(F.col(pid), F.col("x").alias("_px"), F.col("y").alias("_py"), _tile(F.col("x"), tile).alias("tx"), _tile(F.col("y"), tile).alias("ty"))
    right, low = (F.col("tx") + 1) * F.lit(float(tile)), F.col("ty") * F.lit(float(tile))

    def crossings(e: Column) -> Column:
        level = ((e["y1"] > py) != (e["y2"] > py)) & (px < _x_of(e, py)) & ~(right < _x_of(e, py))
        upright = ((e["x1"] > right) != (e["x2"] > right)) & (_left_of(e, right, py) != _left_of(e, right, low))
        return F.coalesce(level, F.lit(False)).cast("int") + F.coalesce(upright, F.lit(False)).cast("int")

    n = F.coalesce(F.aggregate("edges", F.lit(0), lambda a, e: a + crossings(e)), F.lit(0))
    met = p.join(tile_index(verts, tile), ["tx", "ty"]).select(pid, "fid", ((n + F.col("odd")) % 2).alias("_odd"))
    return met.groupBy(pid, "fid").agg(F.sum("_odd").alias("_odd")).where("_odd % 2 = 1").select(pid, "fid")


def _side(p: str, q: str) -> Column:
    """Twice the signed area of the segment x1, y1, x2, y2 and a point."""
    return (F.col("x2") - F.col("x1")) * (F.col(q) - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col(p) - F.col("x1"))


def _met(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """Pairs of segments (of b: u1, v1, u2, v2, other) whose tiles and boxes meet; a pair may come once per shared tile."""
    tb = tiles_of_edges(b, tile).selectExpr("fid as other", "part as o_part", "seq as o_seq", "x1 as u1", "y1 as v1", "x2 as u2", "y2 as v2", "tx", "ty")
    boxes = (
        (F.least("x1", "x2") <= F.greatest("u1", "u2")) & (F.least("u1", "u2") <= F.greatest("x1", "x2"))
        & (F.least("y1", "y2") <= F.greatest("v1", "v2")) & (F.least("v1", "v2") <= F.greatest("y1", "y2"))
    )
    return tiles_of_edges(a, tile).join(tb, ["tx", "ty"]).where(boxes)


def clip_lines(lines: DataFrame, polygons: DataFrame, tile: float) -> DataFrame:
    """What of each line lies inside each polygon: (fid, part, seq, other, t0, t1, x0, y0, x1, y1, length).

    A point inside the longest piece of a segment between two crossings tells in which polygons that
    piece lies; from there each crossing of a polygon's boundary, either way, leaves or enters it.
    ``t0`` and ``t1`` are shares of the segment; ``seq`` is that of the segment's first vertex and
    ``other`` the polygon. A vertex on the segment's line counts as right of it, so a boundary that
    the segment runs along is inside where the polygon lies to the left. Segments without length are
    left out.
    """
    s = edges(lines).where("x1 <> x2 or y1 <> y2")
    key = ["fid", "part", "seq"]
    met = _met(s, edges(polygons), tile)
    den = (F.col("x2") - F.col("x1")) * (F.col("v2") - F.col("v1")) - (F.col("y2") - F.col("y1")) * (F.col("u2") - F.col("u1"))
    t = ((F.col("u1") - F.col("x1")) * (F.col("v2") - F.col("v1")) - (F.col("v1") - F.col("y1")) * (F.col("u2") - F.col("u1"))) / den
    crossed = met.where((_side("u1", "v1") > 0) != (_side("u2", "v2") > 0)).select(*key, "other", "o_part", "o_seq", t.alias("t")).where("t > 0 and t < 1")
    # shuffled once by segment (a part that is always the same number would not count as a key of the groups); a pair comes once per shared
    # tile, and two edges crossed at one place are entered and left there
    cuts = crossed.repartition("fid", "seq").distinct().groupBy(*key, "other", "t").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    cut = cuts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("t", "other"))).alias("_cuts"))
    seg = reused(s.select(*key, "x1", "y1", "x2", "y2").join(cut, key, "left"), "cut-segments")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ends = F.concat(F.array(F.lit(0.0)), F.coalesce(F.col("_cuts.t"), F.array().cast("array<double>")), F.array(F.lit(1.0)))
    longest = F.array_max(F.zip_with(ends, F.slice(ends, 2, F.size(ends) - 1), lambda a, b: F.struct((b - a).alias("w"), a.alias("a"))))
    share, step = longest["a"] + longest["w"] * F.lit(WITHIN_PIECE), F.lit(ASIDE) * F.greatest(*[F.abs(F.col(c)) for c in ("x1", "y1", "x2", "y2")]) / F.sqrt(dx * dx + dy * dy)
    tested = seg.withColumn("_s", share)
    share = F.col("_s")
    points = tested.select(F.struct(*key).alias("piece"), (F.col("x1") + share * dx - step * dy).alias("x"), (F.col("y1") + share * dy + step * dx).alias("y"))
    within = inside(points, polygons, "piece", tile).groupBy("piece").agg(F.collect_list(F.struct(F.lit(None).cast("double").alias("t"), F.col("fid").alias("other"))).alias("_in"))
    none = F.array().cast(f"array<struct<t:double,other:{polygons.schema['fid'].dataType.simpleString()}>>")
    turns = tested.join(within.select("piece.*", "_in"), key, "left").withColumn("_e", F.explode(F.concat(F.coalesce("_in", none), F.coalesce("_cuts", none))))
    rows = turns.groupBy(*key, "x1", "y1", "x2", "y2", F.col("_e.other").alias("other")).agg(
        F.sort_array(F.collect_list("_e.t")).alias("_t"), F.count_if(F.col("_e.t").isNull() | (F.col("_e.t") < F.col("_s"))).alias("_n"))
    begun = rows.withColumn("_t", F.when(F.col("_n") % 2 == 1, F.concat(F.array(F.lit(0.0)), F.col("_t"))).otherwise(F.col("_t")))
    entered = begun.withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(2))))
    kept = entered.withColumn("t0", F.get("_t", F.col("_k"))).withColumn("t1", F.coalesce(F.get("_t", F.col("_k") + 1), F.lit(1.0)))

    def at(share: Column, c: str) -> Column:
        return F.col(c + "1") + share * (F.col(c + "2") - F.col(c + "1"))

    length = (F.col("t1") - F.col("t0")) * F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    t0, t1 = F.col("t0"), F.col("t1")
    return kept.select(*key, "other", "t0", "t1", at(t0, "x").alias("x0"), at(t0, "y").alias("y0"), at(t1, "x").alias("xe"), at(t1, "y").alias("ye"), length.alias("length")).withColumnsRenamed({"xe": "x1", "ye": "y1"})


def clip_points(points: DataFrame, polygons: DataFrame, pid: str, tile: float) -> DataFrame:
    """Rows of ``points`` inside any polygon, each once; features are represented by their centroids."""
    return points.join(inside(points, polygons, pid, tile).select(pid).distinct(), pid, "left_semi")


def intersecting(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """(fid, other): polygons of ``a`` and ``b`` that share at least one point, boundaries included.

    Either two edges meet, or a ring lies wholly inside the other polygon; one vertex tells.
    """
    ea, eb = edges(a), edges(b)
    met = _met(ea, eb, tile)
    su1, su2 = F.signum(_side("u1", "v1")), F.signum(_side("u2", "v2"))
    back = lambda p, q: F.signum((F.col("u2") - F.col("u1")) * (F.col(q) - F.col("v1")) - (F.col("v2") - F.col("v1")) * (F.col(p) - F.col("u1")))
    # boxes meet already: segments meet unless one lies strictly on one side of the other's line
    meet = (su1 * su2 <= 0) & (back("x1", "y1") * back("x2", "y2") <= 0)
    crossing = met.where(meet).select("fid", "other").distinct()

    def vertices_in(v: DataFrame, polygons: DataFrame) -> DataFrame:
        first = v.where("seq = 0").select(F.struct("fid", "part").alias("ring"), "x", "y")
        return inside(first, polygons, "ring", tile).select("ring.fid", F.col("fid").alias("other"))

    held = vertices_in(a, b).unionByName(vertices_in(b, a).select(F.col("other").alias("fid"), F.col("fid").alias("other")))
    return crossing.unionByName(held).distinct()


def intersection_counts(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """How many of ``a`` meet any of ``b``, how many there are of both, and how many different ones in all."""
    n_a = a.select("fid").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    n_b = b.select("fid").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    out = intersecting(a, b, tile).agg(F.countDistinct("fid").alias("n_overlap")).withColumn("n_a", n_a).withColumn("n_b", n_b)
    return out.withColumn("n_unique", F.col("n_a") + F.col("n_b") - F.col("n_overlap"))


def box_and_inside_counts(points: DataFrame, verts: DataFrame, layer: str, pid: str, tile: float) -> DataFrame:
    """Per layer: points in the polygons' joint box, and points inside a polygon."""
    box = verts.agg(
        F.struct(F.min("x").alias("w"), F.min("y").alias("s"), F.max("x").alias("e"), F.max("y").alias("n")).alias("b")
    ).scalar()
    held = inside(points, verts, pid, tile).select(pid).distinct().withColumn("_in", F.lit(1))
    tagged = points.join(held, pid, "left").withColumn("_b", box)
    in_box = F.col("x").between(F.col("_b.w"), F.col("_b.e")) & F.col("y").between(F.col("_b.s"), F.col("_b.n"))
    return tagged.groupBy(layer).agg(F.count_if(in_box).alias("n_box"), F.count("_in").alias("n_inside"))
