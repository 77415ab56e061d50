"""Cell tables: resampling, mosaicking, dilation, assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import cell_id

REDUCERS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def _coarse(f: int) -> list[Column]:
    return [
        F.floor(F.col("row") / f).cast("int").alias("row"),
        F.floor(F.col("col") / f).cast("int").alias("col"),
    ]


def block_reduce(cells: DataFrame, value: str, f: int, how: str = "mean") -> DataFrame:
    """Fine to coarse, ignoring NULL; combines map-side."""
    return cells.groupBy(*_coarse(f)).agg(REDUCERS[how](value).alias(value))


def circular_mean(cells: DataFrame, aspect: str, f: int) -> DataFrame:
    """Mean direction through unit vectors, in degrees 0..360."""
    a = F.radians(aspect)
    u = cells.groupBy(*_coarse(f)).agg(F.avg(F.cos(a)).alias("northness"), F.avg(F.sin(a)).alias("eastness"))
    return u.withColumn("aspect", F.pmod(F.degrees(F.atan2("eastness", "northness")), F.lit(360.0)))


def block_mode(cells: DataFrame, code: str, f: int) -> DataFrame:
    """Most frequent category; ties go to the smallest code."""
    counts = cells.where(F.col(code).isNotNull()).groupBy(*_coarse(f), code).count()
    return counts.groupBy("row", "col").agg(
        F.min_by(code, F.struct((-F.col("count")).alias("c"), F.col(code).alias("k"))).alias(code)
    )


def bilinear(coarse: DataFrame, fine: DataFrame, value: str, f: int) -> DataFrame:
    """Sample a coarse grid at fine cell centres; missing neighbours drop out of the weights.

    The coarse value is sent to the (at most 4) anchor positions it serves, so the
    fine table takes part in a single equi-join and is never duplicated.
    """
    u = (F.col("row") + 0.5) / f - 0.5
    v = (F.col("col") + 0.5) / f - 0.5
    want = fine.withColumn("_r0", F.floor(u).cast("int")).withColumn("_c0", F.floor(v).cast("int")).withColumn(
        "_fr", u - F.floor(u)
    ).withColumn("_fc", v - F.floor(v))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    served = coarse.select("row", "col", value, corner.alias("o")).select(
        (F.col("row") - F.col("o.a")).alias("_r0"), (F.col("col") - F.col("o.b")).alias("_c0"), "o.a", "o.b", value
    )
    anchors = served.groupBy("_r0", "_c0").agg(
        *[
            F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col(value))).alias(f"_v{a}{b}")
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    j = want.join(anchors, ["_r0", "_c0"], "left")
    num, den = F.lit(0.0), F.lit(0.0)
    for a in (0, 1):
        for b in (0, 1):
            wt = (F.col("_fr") if a else 1 - F.col("_fr")) * (F.col("_fc") if b else 1 - F.col("_fc"))
            ok = F.col(f"_v{a}{b}").isNotNull()
            num = num + F.when(ok, wt * F.col(f"_v{a}{b}")).otherwise(0.0)
            den = den + F.when(ok, wt).otherwise(0.0)
    return j.select(*fine.columns, F.when(den > 0, num / den).alias(value))


def nearest_sample(coarse: DataFrame, fine: DataFrame, value: str, f: int) -> DataFrame:
    """Index layers: take the covering coarse cell, never interpolate ids."""
    c = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value))
    on = (F.floor(F.col("row") / f) == F.col("_r")) & (F.floor(F.col("col") / f) == F.col("_c"))
    return fine.join(c, on, "left").drop("_r", "_c")


def to_display(cells: DataFrame, value: str, f: int) -> DataFrame:
    """All four display reductions in one aggregation."""
    return cells.groupBy(*_coarse(f)).agg(*[fn(value).alias(k) for k, fn in REDUCERS.items()])


def flag_share(cells: DataFrame, flag: Column, f: int, floor_share: float = 0.05) -> DataFrame:
    """Share of fine cells flagged, and whether it reaches the floor."""
    share = F.avg(flag.cast("double"))
    return cells.groupBy(*_coarse(f)).agg(share.alias("share"), (share >= floor_share).cast("int").alias("kept"))


def mosaic(tiles: DataFrame, key: Sequence[str], value: str, order: str) -> DataFrame:
    """Overlapping tiles: the last valid value wins."""
    return tiles.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(value, order).alias(value))


def decimate(cells: DataFrame, step: int) -> DataFrame:
    return cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def stack_strips(top: DataFrame, bottom: DataFrame, top_rows: Column) -> DataFrame:
    """Put one strip below another by shifting its rows."""
    return top.unionByName(bottom.withColumn("row", F.col("row") + top_rows))


def mask_to(cells: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """Keep every cell; outside the mask the value becomes NULL."""
    inside = mask.select("cell_id").distinct().withColumn("_in", F.lit(True))
    return cells.join(inside, "cell_id", "left").withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in")


def dilate(points: DataFrame, value: str, order: str) -> DataFrame:
    """Each coarse point paints its 3x3 neighbourhood; the later point wins."""
    shifts = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    )
    painted = points.withColumn("_o", shifts).select(
        (F.col("row") + F.col("_o.a")).alias("row"), (F.col("col") + F.col("_o.b")).alias("col"), value, order
    )
    return painted.groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def assemble(region: DataFrame, layers: DataFrame, names: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """In-region cells with one column per layer: FLOAT, or SMALLINT for the layers in ``categories``.

    ``layers`` is long (cell_id, layer, value): one shuffle on the cell key serves any
    number of layers, where a chain of joins would need one each. A category code that is no
    whole number from 0 to 255 stops the job: codes come from byte rasters, and rounding one
    would make another class of it.
    """
    value = lambda n: F.max(F.when(F.col("layer") == n, F.col("value")))

    def column(n: str) -> Column:
        if n not in categories:
            return value(n).cast("float").alias(n)
        v = value(n)
        bad = F.raise_error(F.concat(F.lit(f"layer {n}: no category code: "), v.cast("string"))).cast("smallint")
        return F.when(v.isNull() | ((v == F.floor(v)) & v.between(0, 255)), v.cast("smallint")).otherwise(bad).alias(n)

    wide = layers.groupBy("cell_id").agg(*[column(n) for n in names])
    return region.join(wide, "cell_id", "left")


KEY_TYPES = {"cell_id": "int", "row": "smallint", "col": "smallint", "x_utm": "float", "y_utm": "float", "fold": "tinyint", "label": "tinyint"}


def compact_keys(df: DataFrame) -> DataFrame:
    """Key columns in their narrowest type; a value that does not fit stops the job (ANSI casts)."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in KEY_TYPES.items() if c in df.columns})


def attach_fold(cells: DataFrame, folds: DataFrame) -> DataFrame:
    """Add ``fold`` by block; a cell without one stops the job when it runs."""
    j = cells.join(folds.select("block", "fold"), "block", "left")
    stop = F.raise_error(F.concat(F.lit("no fold for block "), F.col("block").cast("string")))
    return j.withColumn("fold", F.coalesce(F.col("fold"), stop.cast("int")))


KEY_COLUMNS = ("cell_id", "row", "col", "x_utm", "y_utm", "fold", "label")


def ordered_columns(df: DataFrame) -> list[str]:
    """Keys first, then the rest by group prefix and name."""
    keys = [c for c in KEY_COLUMNS if c in df.columns]
    rest = sorted((c for c in df.columns if c not in keys), key=lambda c: (c.split("_")[0], c))
    return keys + rest


def domain_filter(cells: DataFrame, slope: str = "slope", lc: str = "lc", min_slope: float = 10.0, excluded=(70, 80, 100)):
    """The modelling domain; a NULL slope is out."""
    return cells.where(~F.col(lc).isin(*excluded) & (F.col(slope) > min_slope))


def representative_points(cells: DataFrame, used: DataFrame, step: int, key: str) -> DataFrame:
    """Every k-th coarse cell that is in use."""
    return decimate(cells, step).join(used.select(key).distinct(), key, "left_semi")
