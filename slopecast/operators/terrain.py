"""Slope, aspect, curvature, flow and distance on a lattice of cells.

Neighbourhood operators share one physical plan: cells are copied into square tiles
that carry a thin halo, shuffled once by tile, and every later window or grouping key
starts with the tile, so nothing else moves. A tile's size is fixed, so no task grows
with the lattice.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..config import CHANNEL_CELLS, MIN_SLOPE_DEG
from ..functions.classify import floodprone_index
from .catchment import accumulate

TILE = ["_tr", "_tc"]

# --- fixed values: flow direction codes by (row step, column step) ---
FLOW_CODES = {
    (0, 1): 1,
    (1, 1): 2,
    (1, 0): 4,
    (1, -1): 8,
    (0, -1): 16,
    (-1, -1): 32,
    (-1, 0): 64,
    (-1, 1): 128,
}
# look azimuths (degrees from north) and incidence angles of the view study
LOOK_AZIMUTH = {"ascending": 437.0, "descending": 283.0}
INCIDENCE_DEG = (29.0, 39.0, 46.0)
# ----------------------------------------------------------------------


def with_halo(cells: DataFrame, halo: int, size: int = 256) -> DataFrame:
    """Copies of each cell in every tile whose halo it lies in, shuffled by tile."""

    def tiles(c: str) -> Column:
        return F.array_distinct(
            F.array(*[F.floor((F.col(c) + s) / size).cast("int") for s in (-halo, 0, halo)])
        )

    spread = cells.withColumn("_tr", F.explode(tiles("row"))).withColumn("_tc", F.explode(tiles("col")))
    core = (F.floor(F.col("row") / size) == F.col("_tr")) & (F.floor(F.col("col") / size) == F.col("_tc"))
    return spread.withColumn("_core", core).repartition(*TILE)


def core_only(tiled: DataFrame) -> DataFrame:
    return tiled.where("_core").drop("_core", *TILE)


def _step(z: str, along: str, across: str, res: float) -> Column:
    """Central difference along an axis; one-sided where a neighbour is missing."""
    w = W.partitionBy(*TILE, across).orderBy(along)
    before = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(z).over(w))
    after = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(z).over(w))
    return F.coalesce(
        (after - before) / F.lit(2.0 * res), (after - F.col(z)) / F.lit(res), (F.col(z) - before) / F.lit(res)
    )


def add_gradient(tiled: DataFrame, z: str, res: float, dx: str, dy: str) -> DataFrame:
    """d/dx to the east and d/dy to the north (rows run south)."""
    return tiled.withColumn(dx, _step(z, "col", "row", res)).withColumn(dy, -_step(z, "row", "col", res))


def slope_deg(p: Column, q: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(p * p + q * q)))


def aspect_rad(p: Column, q: Column) -> Column:
    return F.atan2(-p, q)


def surface(cells: DataFrame, z: str = "elev", res: float = 100.0) -> DataFrame:
    """p, q, slope, aspect (radians and 0..360), northness and eastness."""
    g = core_only(add_gradient(with_halo(cells, 1), z, res, "p", "q"))
    a = aspect_rad(F.col("p"), F.col("q"))
    return (
        g.withColumn("slope_deg", slope_deg(F.col("p"), F.col("q")))
        .withColumn("aspect", a)
        .withColumn("aspect_deg", F.pmod(F.degrees(a), F.lit(360.0)))
        .withColumn("northness", F.cos(a))
        .withColumn("eastness", F.sin(a))
    )


def curvature(cells: DataFrame, z: str = "elev", res: float = 100.0, flat: float = 1e-4, limit: float = 0.5) -> DataFrame:
    """Profile and plan curvature; 0 on near-flat ground, clipped at both ends.

    The second differences follow the published layers: t is taken down the rows of
    d/dx, s along the columns of d/dy.
    """
    t = add_gradient(with_halo(cells, 2), z, res, "p", "q")
    t = (
        t.withColumn("_r", _step("p", "col", "row", res))
        .withColumn("_t", -_step("p", "row", "col", res))
        .withColumn("_s", _step("q", "col", "row", res))
    )
    p, q, r, s, tt = (F.col(c) for c in ("p", "q", "_r", "_s", "_t"))
    g2 = p * p + q * q
    prof = -(r * p * p + F.lit(2.0) * s * p * q + tt * q * q) / (g2 * F.pow(F.lit(1.0) + g2, F.lit(1.5)))
    plan = -(r * q * q - F.lit(2.0) * s * p * q + tt * p * p) / F.pow(g2, F.lit(1.5))

    def tame(v: Column) -> Column:
        return F.when(g2 < flat, 0.0).otherwise(F.least(F.lit(limit), F.greatest(F.lit(-limit), v)))

    return core_only(
        t.withColumn("profile_curv", tame(prof)).withColumn("plan_curv", tame(plan)).drop("_r", "_t", "_s")
    )


def flow_direction(cells: DataFrame, z: str = "elev", res: float = 100.0) -> DataFrame:
    """Steepest of the eight descents: code and cell below; NULL at a pit. Ties go to the smaller code."""
    t = with_halo(cells.select("cell_id", "row", "col", z), 1)
    runs = {code: res * (2.0**0.5 if dr and dc else 1.0) for (dr, dc), code in FLOW_CODES.items()}
    places = {(0, 0): 0} | FLOW_CODES  # a cell offers itself to its eight neighbours, and to its own place
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(code).alias("code")) for (dr, dc), code in places.items()])
    offered = t.select(*TILE, "row", "col", "cell_id", z, "_core", F.explode(steps).alias("s")).select(
        *TILE, (F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"), "cell_id", z, "_core", F.col("s.code").alias("code"))
    here = {code: F.col("code") == code for code in places.values()}
    # one number per place and measure: a group is a fixed-size row of a hash table, and no neighbour has to be joined
    j = offered.groupBy(*TILE, "row", "col").agg(
        F.max(F.when(here[0], F.col("_core"))).alias("_core"),
        *[F.max(F.when(h, F.col("cell_id"))).alias(f"_id{code}") for code, h in here.items()],
        *[F.max(F.when(h, F.col(z))).alias(f"_z{code}") for code, h in here.items()],
    ).where("_core").select(F.col("_id0").alias("cell_id"), "row", "col", F.col("_z0").alias(z), *[f"_{c}{code}" for code in runs for c in ("id", "z")])
    drops = F.array(*[
        F.struct((-(F.col(z) - F.col(f"_z{code}")) / F.lit(run)).alias("neg_drop"), F.lit(code).alias("code"), F.col(f"_id{code}").alias("down"))
        for code, run in runs.items()
    ])
    best = F.array_min(F.filter(drops, lambda d: d["neg_drop"] < 0))
    return j.select(
        "cell_id", "row", "col", z, best["code"].alias("flow_code"), best["down"].alias("down"),
        (-best["neg_drop"]).alias("drop"),
    )


def flow_accumulation(flow: DataFrame) -> DataFrame:
    """Number of cells upslope of each cell (itself not counted). Pits end a path."""
    edges = flow.select(F.col("cell_id").alias("node"), "down")
    ones = flow.select(F.col("cell_id").alias("node"), F.lit(1).cast("long").alias("n"))
    return accumulate(edges, ones, ["n"]).select(F.col("node").alias("cell_id"), (F.col("n") - 1).alias("acc"))


def wetness(acc: Column, slope: Column, cell: float = 100.0) -> Column:
    """Topographic wetness index."""
    return F.ln((acc + F.lit(1.0)) * F.lit(cell) / F.tan(F.radians(F.greatest(slope, F.lit(MIN_SLOPE_DEG)))))


# --- distance to the nearest flagged cell ------------------------------------------


def _row_pass(targets: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
    """Nearest flagged cell for each target of one lattice row, linear in its columns and targets.

    ``columns`` has, for each column holding a flag, the nearest flagged row there. Squared
    distance along the row is one parabola per column, and their lower envelope is swept once.
    Turning points are compared as exact fractions, and parabolas that only touch the envelope
    stay on it, so that every tie is seen.
    """
    import numpy as np

    out = targets[["cell_id"]].copy()
    if len(columns) == 0:
        return out.assign(d2=np.nan, src_row=-1, src_col=-1)
    by = columns.sort_values("col")
    c, rows = by["col"].to_numpy(np.int64), by["src_row"].to_numpy(np.int64)
    lift = c * c + by["g"].to_numpy(np.int64) ** 2
    at, num, den = [0], [0], [0]  # on the envelope: column, and the fraction from which on it is lowest
    for k in range(1, len(c)):
        while True:
            n, d = int(lift[k] - lift[at[-1]]), int(2 * (c[k] - c[at[-1]]))
            if len(at) == 1 or n * den[-1] >= num[-1] * d:
                break
            at.pop(), num.pop(), den.pop()
        at.append(k), num.append(n), den.append(d)
    hull, n, d = np.array(at), np.array(num, np.int64), np.array(den, np.int64)
    starts = -(-n[1:] // d[1:])
    x = targets["col"].to_numpy(np.int64)
    i = np.searchsorted(starts, x, "right")
    best, open_ = hull[i], np.arange(len(x))
    while len(open_):  # where a target lies on a turning point, the parabola before is as low
        i, open_ = i[(n[i] == x[open_] * d[i]) & (i > 0)] - 1, open_[(n[i] == x[open_] * d[i]) & (i > 0)]
        other, now = hull[i], best[open_]
        better = (rows[other] < rows[now]) | ((rows[other] == rows[now]) & (c[other] < c[now]))
        best[open_] = np.where(better, other, now)
    return out.assign(d2=(lift[best] + x * x - 2 * x * c[best]).astype(float), src_row=rows[best], src_col=c[best])


def nearest_flag(cells: DataFrame, flags: DataFrame) -> DataFrame:
    """Exact distance (in cells) to the nearest flagged cell, and which one it is.

    Two passes. Down each flagged column a pair of windows finds the nearest flagged row;
    then each lattice row is settled on its own. A group is one row or one column of the
    lattice: the side of the map, never its area.
    Ties go to the smallest (row, col).
    """
    span = cells.agg(F.struct(F.min("row").alias("lo"), F.max("row").alias("hi")).alias("s")).scalar()
    # fresh names: the flags are often derived from the very cells they are measured from
    marks = flags.select(F.col("row").alias("row"), F.col("col").alias("col")).distinct().withColumn("f", F.col("row"))
    ladder = (
        marks.select("col").distinct().withColumn("_s", span)
        .select(F.explode(F.sequence("_s.lo", "_s.hi")).alias("row"), "col", F.lit(None).cast("int").alias("f"))
    )
    full = ladder.unionByName(marks).groupBy("col", "row").agg(F.max("f").alias("f"))
    w = W.partitionBy("col")
    upto = (W.unboundedPreceding, 0)
    seen = full.withColumn("_a", F.last("f", True).over(w.orderBy("row").rowsBetween(*upto))).withColumn(
        "_b", F.last("f", True).over(w.orderBy(F.desc("row")).rowsBetween(*upto))
    )
    above, below = F.col("row") - F.col("_a"), F.col("_b") - F.col("row")
    take_above = F.col("_b").isNull() | (F.col("_a").isNotNull() & (above <= below))
    per_column = seen.select(
        "row", "col",
        F.when(take_above, above).otherwise(below).alias("g"),
        F.when(take_above, F.col("_a")).otherwise(F.col("_b")).alias("src_row"),
    )
    settled = (
        cells.select("cell_id", "row", "col").groupBy("row")
        .cogroup(per_column.groupBy("row"))
        .applyInPandas(
            lambda t, c: _row_pass(t, c) if len(t) else pd.DataFrame(
                {"cell_id": pd.Series(dtype="int64"), "d2": pd.Series(dtype="float64"),
                 "src_row": pd.Series(dtype="int64"), "src_col": pd.Series(dtype="int64")}),
            "cell_id long, d2 double, src_row long, src_col long",
        )
    )
    known = F.col("src_row") >= 0
    return settled.select(
        "cell_id",
        F.when(known, F.sqrt("d2")).alias("dist"),
        F.when(known, F.col("src_row").cast("int")).alias("src_row"),
        F.when(known, F.col("src_col").cast("int")).alias("src_col"),
    )


def height_above_drainage(cells: DataFrame, acc: DataFrame, z: str = "elev", channel_cells: int = CHANNEL_CELLS) -> DataFrame:
    """Elevation over the nearest channel cell, never negative."""
    both = cells.join(acc, "cell_id")
    channels = both.where(F.col("acc") >= channel_cells)
    near = nearest_flag(cells, channels)
    zc = channels.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), F.col(z).alias("_zc"))
    return (
        both.join(near, "cell_id").join(zc, ["src_row", "src_col"], "left")
        .withColumn("hand", F.greatest(F.col(z) - F.col("_zc"), F.lit(0.0)))
        .drop("_zc")
    )


def flood_index(hand_table: DataFrame) -> DataFrame:
    return hand_table.withColumn("flood_index", floodprone_index(F.col("hand"), F.col("acc")))


# --- view geometry ------------------------------------------------------------------


def effective_slope(slope: Column, aspect_deg: Column, look: float) -> Column:
    return F.degrees(F.atan(F.tan(F.radians(slope)) * F.cos(F.radians(aspect_deg - F.lit(look)))))


def view_geometry(cells: DataFrame, slope: str, aspect_deg: str, looks=LOOK_AZIMUTH, angles: Sequence[float] = INCIDENCE_DEG) -> DataFrame:
    """Layover, shadow and usable shares per orbit and incidence, in one pass."""
    rows = []
    for name, look in looks.items():
        a = effective_slope(F.col(slope), F.col(aspect_deg), look)
        for inc in angles:
            lay, shd = a >= inc, a <= inc - 90.0
            rows.append(
                F.struct(
                    F.lit(name).alias("orbit"), F.lit(float(inc)).alias("incidence"),
                    F.avg(lay.cast("double")).alias("layover"), F.avg(shd.cast("double")).alias("shadow"),
                    F.avg((~lay & ~shd).cast("double")).alias("usable"),
                )
            )
    for inc in angles:
        ok = [
            (effective_slope(F.col(slope), F.col(aspect_deg), look) < inc)
            & (effective_slope(F.col(slope), F.col(aspect_deg), look) > inc - 90.0)
            for look in looks.values()
        ]
        for tag, cond in (("either", ok[0] | ok[1]), ("both", ok[0] & ok[1])):
            nul = F.lit(None).cast("double")
            rows.append(
                F.struct(
                    F.lit(tag).alias("orbit"), F.lit(float(inc)).alias("incidence"), nul.alias("layover"),
                    nul.alias("shadow"), F.avg(cond.cast("double")).alias("usable"),
                )
            )
    return cells.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def texture_check(df: DataFrame, parts: Sequence[str], total: float, tol: float, by_depth: Sequence[str]) -> DataFrame:
    """Do fractions add up, and does a property fall steadily with depth?"""
    s = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    steady = F.lit(True)
    for a, b in zip(by_depth, by_depth[1:]):
        steady = steady & (F.col(a) >= F.col(b))
    return df.agg(
        F.avg((F.abs(s - total) <= tol).cast("double")).alias("share_closing"),
        F.avg(steady.cast("double")).alias("share_monotone"),
    )
