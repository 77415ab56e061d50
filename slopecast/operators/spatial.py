"""Spatial joins by tile, polygon fill by scan line, nearest neighbours by level."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import durable


def edges(verts: DataFrame, stretch: int = 4096) -> DataFrame:
    """Consecutive vertices of each ring or line part as segments.

    ``seq`` counts 0, 1, 2, ... within a part. A part is cut into stretches that share
    their end vertex, so one enormous line is paired up by many tasks.
    """
    here = F.floor(F.col("seq") / stretch).cast("long")
    also = F.when(F.col("seq") % stretch == 0, F.array(here, here - 1)).otherwise(F.array(here))
    cut = verts.withColumn("_s", F.explode(also))
    w = W.partitionBy("fid", "part", "_s").orderBy("seq")
    nxt = F.lead(F.struct("seq", "x", "y")).over(w)
    e = cut.select("fid", "part", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt.alias("_n"))
    return e.where(F.col("_n").isNotNull()).select(
        "fid", "part", "seq", "x1", "y1", F.col("_n.x").alias("x2"), F.col("_n.y").alias("y2")
    )


def geometry_measures(verts: DataFrame) -> DataFrame:
    """Signed-area based area, boundary length, centroid, vertex mean and part count."""
    e = edges(verts)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    per_part = e.groupBy("fid", "part").agg(
        (F.sum(cross) / 2).alias("a"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"),
        F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))).alias("len"),
        F.avg("x1").alias("vx"), F.avg("y1").alias("vy"),
    )
    # the first part is the outer ring, the others are holes
    sign = F.when(F.col("part") == 0, 1.0).otherwise(-1.0) * F.signum("a")
    return per_part.groupBy("fid").agg(
        F.sum(F.col("a") * sign).alias("area"),
        F.sum("len").alias("length"),
        (F.sum(F.col("mx") * sign) / (6 * F.sum(F.col("a") * sign))).alias("cx"),
        (F.sum(F.col("my") * sign) / (6 * F.sum(F.col("a") * sign))).alias("cy"),
        F.max(F.when(F.col("part") == 0, F.col("vx"))).alias("ring_x"),
        F.max(F.when(F.col("part") == 0, F.col("vy"))).alias("ring_y"),
        F.count(F.lit(1)).alias("parts"),
    )


def bounds(verts: DataFrame) -> DataFrame:
    return verts.groupBy("fid").agg(
        F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north")
    )


def _centre_range(lo: Column, hi: Column, cell: float) -> tuple[Column, Column]:
    """Index range of cell centres c with lo <= c < hi."""
    return (
        F.ceil(lo / F.lit(cell) - F.lit(0.5)).cast("int"),
        (F.ceil(hi / F.lit(cell) - F.lit(0.5)) - 1).cast("int"),
    )


def fill_polygons(verts: DataFrame, cell: float = 1.0) -> DataFrame:
    """Cells whose centre lies inside (even-odd over all rings), as (fid, row, col).

    Each edge marks the rows it crosses; sorted crossings pair up into spans. The cost is
    the output plus the boundary: no cell is ever tested against a polygon.
    """
    e = edges(verts).where(F.col("y1") != F.col("y2"))
    lo, hi = _centre_range(F.least("y1", "y2"), F.greatest("y1", "y2"), cell)
    rows = e.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn(
        "row", F.explode(F.sequence("_lo", "_hi"))
    )
    yc = (F.col("row") + F.lit(0.5)) * F.lit(cell)
    crossings = rows.select(
        "fid", "row",
        (F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("xi"),
    )
    w = W.partitionBy("fid", "row").orderBy("xi")
    spans = crossings.withColumn("_k", F.row_number().over(w)).withColumn("_x2", F.lead("xi").over(w)).where("_k % 2 = 1")
    a, b = _centre_range(F.col("xi"), F.col("_x2"), cell)
    return (
        spans.withColumn("_a", a).withColumn("_b", b).where("_a <= _b")
        .select("fid", "row", F.explode(F.sequence("_a", "_b")).alias("col"))
    )


def touched_by_edges(e: DataFrame, cell: float = 1.0) -> DataFrame:
    """Cells any segment passes through: per row of the segment, the columns it spans there."""
    r0 = F.floor(F.least("y1", "y2") / cell).cast("int")
    r1 = F.floor(F.greatest("y1", "y2") / cell).cast("int")
    rows = e.withColumn("row", F.explode(F.sequence(r0, r1)))
    lo = F.greatest(F.least("y1", "y2"), F.col("row") * F.lit(cell))
    hi = F.least(F.greatest("y1", "y2"), (F.col("row") + 1) * F.lit(cell))
    flat = F.col("y1") == F.col("y2")

    def x_at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))

    xa = F.when(flat, F.col("x1")).otherwise(x_at(lo))
    xb = F.when(flat, F.col("x2")).otherwise(x_at(hi))
    cols = F.sequence(F.floor(F.least(xa, xb) / cell).cast("int"), F.floor(F.greatest(xa, xb) / cell).cast("int"))
    return rows.select("fid", "row", F.explode(cols).alias("col"))


def touched_cells(verts: DataFrame, filled: bool = True, cell: float = 1.0) -> DataFrame:
    """Every cell a polygon or line touches: boundary cells plus, for polygons, the inside."""
    t = touched_by_edges(edges(verts), cell)
    if filled:
        t = t.unionByName(fill_polygons(verts, cell))
    return t.distinct()


def burn(filled: DataFrame, code: Column, order: Column) -> DataFrame:
    """One code per cell of filled features; where they overlap the later one in ``order`` wins."""
    return filled.groupBy("row", "col").agg(F.max_by(code, order).alias("code"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, tile: float) -> DataFrame:
    """Points joined to every bounding box that contains them (tile equi-join, then exact)."""
    def span(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.col(b) / tile).cast("int")))

    laid = boxes.withColumn("_tx", span("west", "east")).withColumn("_ty", span("south", "north"))
    p = points.withColumn("_tx", F.floor(F.col("x") / tile).cast("int")).withColumn(
        "_ty", F.floor(F.col("y") / tile).cast("int")
    )
    return (
        p.join(laid, ["_tx", "_ty"])
        .where(F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north")))
        .drop("_tx", "_ty")
    )


def source_bitmask(marks: DataFrame) -> DataFrame:
    """(cell_id, bit) to a mask per cell and how many inventories agree."""
    m = marks.groupBy("cell_id").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("bit").cast("int"))).alias("mask")
    )
    return m.withColumn("n_sources", F.bit_count("mask").cast("int"))


def overlap_count(a: DataFrame, b: DataFrame, cell: float = 1.0) -> DataFrame:
    """How many of A share a cell with any of B, and the unique total of both."""
    ta, tb = touched_cells(a, cell=cell), touched_cells(b, cell=cell)
    hit = ta.join(tb.select("row", "col").distinct(), ["row", "col"], "left_semi").select("fid").distinct()
    n_a = a.select("fid").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    n_b = b.select("fid").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    out = hit.agg(F.count(F.lit(1)).alias("n_overlap")).withColumn("n_a", n_a).withColumn("n_b", n_b)
    return out.withColumn("n_unique", F.col("n_a") + F.col("n_b") - F.col("n_overlap"))


def _spread(levels: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in levels]))


def _ring(prefix: str = "") -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    lid: str,
    rid: Sequence[str],
    lxy: tuple[Column, Column],
    rxy: tuple[Column, Column],
    cell: float,
    dist: Column | Callable[[], list[Column]],
    tie: Sequence[Column] | None = None,
    metric: str = "euclid",
    x_scale: Column | None = None,
    light: int = 32,
) -> DataFrame:
    """Exact nearest row of ``right`` for every row of ``left``: (lid, *rid, dist).

    A bulk quadtree search, written as joins on (level, x, y) bucket keys of side
    ``cell`` * 2^level:

    1. per occupied left bucket, the lowest level whose 3x3 neighbourhood holds anything;
    2. each left row lists the occupied buckets around it at that level and drops every
       bucket whose nearest corner is farther than some other bucket's farthest corner;
    3. kept buckets that still hold more than ``light`` rows are split into their
       occupied quarters' quarters and pruned again, until they are light or of side ``cell``;
    4. only then do left rows meet right rows.

    So a left row meets a bounded handful of buckets of bounded content, even when most
    of ``right`` sits in one far-away cluster; nothing is capped, pruning is by proof.

    ``lxy``/``rxy`` are coordinates in which ``dist`` is ``metric`` (euclid or chebyshev),
    after stretching x by ``x_scale`` (a left column between 0.36 and 1, such as the
    cosine of latitude). ``dist`` may be a list: later entries settle equal distances,
    then ``tie`` (default: the ``rid`` columns in order). Column names must not clash.
    """
    shift = lambda c, l: F.call_function("shiftright", c, l)
    reach = 2 if x_scale is None else 3
    lb = (
        left.withColumn("_px", lxy[0]).withColumn("_py", lxy[1]).withColumn("_sx", F.lit(1.0) if x_scale is None else x_scale)
        .withColumn("_bx", F.floor(F.col("_px") / cell).cast("long")).withColumn("_by", F.floor(F.col("_py") / cell).cast("long"))
    )
    rb = right.withColumn("_qx", F.floor(rxy[0] / cell).cast("long")).withColumn("_qy", F.floor(rxy[1] / cell).cast("long"))
    filled = rb.groupBy("_qx", "_qy").agg(F.count(F.lit(1)).alias("_n"))
    ends = (
        lb.select("_bx", "_by").unionByName(filled.select(F.col("_qx").alias("_bx"), F.col("_qy").alias("_by")))
        .agg(F.min("_bx"), F.max("_bx"), F.min("_by"), F.max("_by")).first()
    )
    top = 1 if ends[0] is None else math.ceil(math.log2(max(ends[1] - ends[0], ends[3] - ends[2], 1) + 1)) + 1
    # the pyramid of occupied buckets, smallest table of the search, is built once
    pyramid = durable(
        filled.withColumn("_l", _spread(range(top + 1)))
        .groupBy("_l", shift(F.col("_qx"), F.col("_l")).alias("_cx"), shift(F.col("_qy"), F.col("_l")).alias("_cy"))
        .agg(F.sum("_n").alias("_n"))
    )
    covered = pyramid.withColumn("_o", _ring()).select(
        "_l", (F.col("_cx") + F.col("_o.a")).alias("_x"), (F.col("_cy") + F.col("_o.b")).alias("_y")
    ).distinct()
    asked = lb.select("_bx", "_by").distinct().withColumn("_l", _spread(range(top + 1))).withColumn(
        "_x", shift(F.col("_bx"), F.col("_l"))
    ).withColumn("_y", shift(F.col("_by"), F.col("_l")))
    # nine places of every bucket are estimated as one: without the hint they would be broadcast at any size
    level = asked.hint("merge").join(covered, ["_l", "_x", "_y"], "left_semi").groupBy("_bx", "_by").agg(F.min("_l").alias("_l"))
    placed = lb.select(F.col(lid).alias("_lid"), "_px", "_py", "_sx", "_bx", "_by").join(level, ["_bx", "_by"])
    around = pyramid.select(
        "_l", "_cx", "_cy", "_n", F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_o")
    ).select(
        "_l", "_cx", "_cy", "_n",
        (shift(F.col("_cx"), F.lit(reach)) + F.col("_o.a")).alias("_x"), (shift(F.col("_cy"), F.lit(reach)) + F.col("_o.b")).alias("_y"),
    )
    seen = placed.withColumn("_x", shift(F.col("_bx"), F.col("_l") + reach)).withColumn(
        "_y", shift(F.col("_by"), F.col("_l") + reach)
    ).hint("merge").join(around, ["_l", "_x", "_y"])

    def pruned(cand: DataFrame) -> DataFrame:
        side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_l"))
        x0, y0 = F.col("_cx") * side, F.col("_cy") * side
        near_x = F.greatest(F.lit(0.0), x0 - F.col("_px"), F.col("_px") - x0 - side) * F.col("_sx")
        near_y = F.greatest(F.lit(0.0), y0 - F.col("_py"), F.col("_py") - y0 - side)
        far_x = F.greatest(F.abs(F.col("_px") - x0), F.abs(F.col("_px") - x0 - side)) * F.col("_sx")
        far_y = F.greatest(F.abs(F.col("_py") - y0), F.abs(F.col("_py") - y0 - side))
        if metric == "chebyshev":
            lo, hi = F.greatest(near_x, near_y), F.greatest(far_x, far_y)
        else:
            lo, hi = F.sqrt(near_x * near_x + near_y * near_y), F.sqrt(far_x * far_x + far_y * far_y)
        per = cand.groupBy("_lid", "_px", "_py", "_sx").agg(
            F.min(hi).alias("_hi"), F.collect_list(F.struct(lo.alias("lo"), "_l", "_cx", "_cy", "_n")).alias("_c")
        )
        kept = F.filter("_c", lambda c: c["lo"] <= F.col("_hi") * F.lit(1.0 + 1e-9))
        return per.select("_lid", "_px", "_py", "_sx", F.explode(kept).alias("_k")).select(
            "_lid", "_px", "_py", "_sx", "_k._l", "_k._cx", "_k._cy", "_k._n"
        )

    cand = durable(pruned(seen))
    heavy = (F.col("_n") > light) & (F.col("_l") > 0)
    while cand.where(heavy).limit(1).count():
        down = F.least(F.lit(2), F.col("_l"))
        parts = pyramid.select(F.col("_l").alias("_pl"), F.col("_cx").alias("_kx"), F.col("_cy").alias("_ky"), F.col("_n").alias("_kn"))
        split = (
            cand.where(heavy).withColumn("_pl", F.col("_l") - down)
            .join(
                parts.withColumn("_d", F.explode(F.array(F.lit(1), F.lit(2))))
                .withColumn("_l", F.col("_pl") + F.col("_d"))
                .withColumn("_cx", shift(F.col("_kx"), F.col("_d"))).withColumn("_cy", shift(F.col("_ky"), F.col("_d"))),
                ["_l", "_pl", "_cx", "_cy"],
            )
            .select("_lid", "_px", "_py", "_sx", F.col("_pl").alias("_l"), F.col("_kx").alias("_cx"), F.col("_ky").alias("_cy"), F.col("_kn").alias("_n"))
        )
        cand = durable(pruned(split.unionByName(cand.where(~heavy))))
    used = sorted(r[0] for r in cand.select("_l").distinct().collect()) or [0]  # at most one per level
    served = rb.withColumn("_l", _spread(used)).withColumn("_cx", shift(F.col("_qx"), F.col("_l"))).withColumn(
        "_cy", shift(F.col("_qy"), F.col("_l"))
    ).drop("_qx", "_qy")
    asking = left.join(cand.select("_lid", "_l", "_cx", "_cy"), left[lid] == F.col("_lid")).drop("_lid")
    order = [dist] if isinstance(dist, Column) else dist()
    named = [c.alias(f"k{i}") for i, c in enumerate([*order, *(tie or [F.col(r) for r in rid])])]

    def met(rows: DataFrame) -> DataFrame:
        return rows.hint("merge").join(served, ["_l", "_cx", "_cy"])

    # the least distance is found by hashing; the minimum of a struct sorts, and only rows about as near get there
    least = met(asking).groupBy(lid).agg(F.min(order[0]).alias("_least")).withColumnRenamed(lid, "_lid")
    close = met(asking.join(least, asking[lid] == F.col("_lid")).drop("_lid")).where(order[0] <= F.col("_least") * F.lit(1.0 + 1e-9))
    best = close.groupBy(lid).agg(F.min(F.struct(*named, F.struct(*rid).alias("r"))).alias("_m"))
    return best.select(lid, *[F.col(f"_m.r.{r}").alias(r) for r in rid], F.col("_m.k0").alias("dist"))


def snap_within(points: DataFrame, cells: DataFrame, pid: str, radius: int) -> DataFrame:
    """Nearest listed cell inside a square of half-width ``radius`` cells; NULL when none.

    ``points`` and ``cells`` carry integer (row, col). Both sides meet on square buckets
    as wide as the radius, so a cell is listed under nine of them. Sizes are estimated without
    that blow-up, so the join is asked to sort: its sides would be broadcast at any size.
    A pair is one long, ordered by distance, row and column, whose minimum needs no sort.
    """
    p = points.select(pid, F.col("row").alias("_pr"), F.col("col").alias("_pc"))
    asked = p.withColumn("_x", F.floor(F.col("_pr") / radius)).withColumn("_y", F.floor(F.col("_pc") / radius))
    listed = cells.select("row", "col", _ring().alias("_o")).select(
        "row", "col", (F.floor(F.col("row") / radius) + F.col("_o.a")).alias("_x"), (F.floor(F.col("col") / radius) + F.col("_o.b")).alias("_y")
    )
    side = 2 * radius + 1
    dr, dc = (F.col("row") - F.col("_pr")).cast("long"), (F.col("col") - F.col("_pc")).cast("long")
    near = asked.hint("merge").join(listed, ["_x", "_y"]).where((F.abs(dr) <= radius) & (F.abs(dc) <= radius))
    packed = (dr * dr + dc * dc) * (side * side) + (dr + radius) * side + dc + radius
    found = near.groupBy(pid, "_pr", "_pc").agg(F.min(packed).alias("k"))
    at = F.pmod("k", F.lit(side * side))
    row = (F.col("_pr") + F.floor(at / side) - radius).cast(cells.schema["row"].dataType)
    col = (F.col("_pc") + F.pmod(at, F.lit(side)) - radius).cast(cells.schema["col"].dataType)
    best = found.groupBy(pid).agg(F.min(F.struct(F.floor(F.col("k") / (side * side)).alias("d2"), row.alias("row"), col.alias("col"))).alias("m"))
    return p.select(pid).join(best, pid, "left").select(
        pid, F.col("m.row").alias("snap_row"), F.col("m.col").alias("snap_col"), F.sqrt("m.d2").alias("snap_dist")
    )


def nearest_by_rings(points: DataFrame, cells: DataFrame, pid: str, max_rings: int = 40) -> DataFrame:
    """First non-empty square ring around each point, and the Euclid-nearest cell in it."""
    p = points.select(pid, F.col("row").alias("_pr"), F.col("col").alias("_pc"))
    c = cells.select("row", "col")
    dr, dc = F.col("row") - F.col("_pr"), F.col("col") - F.col("_pc")
    ring = F.greatest(F.abs(dr), F.abs(dc))
    hit = nearest(
        p, c, pid, ["row", "col"], (F.col("_pr"), F.col("_pc")), (F.col("row"), F.col("col")), 1.0,
        lambda: [ring, dr * dr + dc * dc], metric="chebyshev",
    ).where(F.col("dist") <= max_rings)
    return points.select(pid).join(hit, pid, "left").select(
        pid, F.col("row").alias("flood_row"), F.col("col").alias("flood_col"), F.col("dist").alias("rings")
    )


def corridor(points: DataFrame, rows: int, cols: int, km_row: float, km_col: float, half_km: float) -> DataFrame:
    """Lattice cells within a distance of any point: a disc stamped once per distinct cell."""
    rr, cc = max(round(half_km / km_row), 1), max(round(half_km / km_col), 1)
    disc = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
        for a in range(-rr, rr + 1)
        for b in range(-cc, cc + 1)
        if (a * km_row) ** 2 + (b * km_col) ** 2 <= half_km**2
    ]
    stamped = points.select("row", "col").distinct().withColumn("_o", F.explode(F.array(*disc))).select(
        (F.col("row") + F.col("_o.a")).alias("row"), (F.col("col") + F.col("_o.b")).alias("col")
    )
    return stamped.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).distinct()
