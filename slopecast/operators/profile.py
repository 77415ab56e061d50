"""Layer profiles, safe synthetic rows, and data-quality facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import seeded_uniform
from .aggregates import class_share
from .ranking import percentiles

BINS = 28
TOP_CLASSES = 12


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "layer", "v")


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coverage, mean and exact p0, p1, p50, p99, p100 for all layers at once."""
    long = _long(df, cols)
    pct = percentiles(long, "v", [0.0, 0.01, 0.5, 0.99, 1.0], ["layer"])
    base = long.groupBy("layer").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"), F.avg("v").alias("mean"))
    return base.join(pct, "layer").select(
        "layer", "coverage", "mean", F.col("p0").alias("min"), F.col("p1").alias("p01"), F.col("p2").alias("p50"),
        F.col("p3").alias("p99"), F.col("p4").alias("max"),
    )


def numeric_histograms(df: DataFrame, cols: Sequence[str], bins: int = BINS) -> DataFrame:
    """Equal-width counts on [p1, p99] of each layer; values outside are clipped to the ends."""
    long = _long(df, cols).where(F.col("v").isNotNull())
    ends = percentiles(long, "v", [0.01, 0.99], ["layer"]).select("layer", F.col("p0").alias("lo"), F.col("p1").alias("hi"))
    x = long.join(ends, "layer")
    width = (F.col("hi") - F.col("lo")) / bins
    clipped = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi"))
    b = F.when(width > 0, F.least(F.floor((clipped - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return x.groupBy("layer", "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_classes(df: DataFrame, c: str, k: int = TOP_CLASSES) -> DataFrame:
    """The ``k`` largest classes, and one row with a NULL class for all others."""
    n = class_share(df, c)
    top = n.orderBy(F.desc("count"), c).limit(k)
    rest = n.join(top.select(c), c, "left_anti").agg(F.lit(None).cast(dict(n.dtypes)[c]).alias(c), F.sum("count").alias("count"), F.sum("share").alias("share"))
    return top.unionByName(rest.where("count is not null"))


def _draw_spec(hist: DataFrame, layer: str) -> Column:
    """A layer's histogram as one small value: cumulative counts per bin and both ends."""
    upto = F.sum("n").over(W.partitionBy("layer").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return (
        hist.where(F.col("layer") == layer).withColumn("c", upto)
        .agg(F.struct(
            F.sort_array(F.collect_list(F.struct("c", "bin"))).alias("cum"), F.max("c").alias("t"),
            F.first("lo").alias("lo"), F.first("hi").alias("hi")).alias("s"))
        .scalar()
    )


def synth_rows(hist: DataFrame, layers: Sequence[str], ids: DataFrame, seed: int = 0, bins: int = BINS) -> DataFrame:
    """Every layer drawn on its own: marginals are kept, joint structure is not.

    A histogram is at most ``bins`` numbers, so it travels as one array: each id picks its
    bin by one seeded uniform and its place in the bin by another. No join.
    """
    out = ids
    for c in layers:
        out = out.withColumn("_s", _draw_spec(hist, c)).withColumn(
            "_u", seeded_uniform(f"{c}-bin-{seed}", "id") * F.col("_s.t")
        )
        pick = F.filter(F.col("_s.cum"), lambda e: e["c"] > F.col("_u"))[0]["bin"]
        within = seeded_uniform(f"{c}-in-{seed}", "id")
        value = F.col("_s.lo") + (pick + within) * (F.col("_s.hi") - F.col("_s.lo")) / bins
        out = out.withColumn(c, value).drop("_s", "_u")
    return out


def privacy_evidence(real: DataFrame, synth: DataFrame, a: str, b: str) -> DataFrame:
    r = real.agg(F.corr(a, b).alias("real_corr"))
    return r.withColumn("synth_corr", synth.agg(F.corr(a, b).alias("c")).scalar())


def coarseness(hist: DataFrame, fine_cells: Column, shown_cells: Column, cell_km: float, bins: int = BINS) -> DataFrame:
    """How coarse the published form is: reduction factor, km per pixel, histogram half-bin."""
    return hist.groupBy("layer").agg(
        F.first((F.col("hi") - F.col("lo")) / (2 * bins)).alias("half_bin")
    ).withColumn("reduction", fine_cells / shown_cells).withColumn("km_per_pixel", F.lit(cell_km) * F.sqrt(F.col("reduction")))


def inspect_files(files: DataFrame, folder: Column, suffix: Column, name: str, size: str) -> DataFrame:
    """One representative per (folder, suffix), with how many there are and their total size."""
    return files.groupBy(folder.alias("folder"), suffix.alias("suffix")).agg(
        F.min(name).alias("representative"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")
    )


def label_quality(labels: DataFrame, day: str, accuracy: str, precise: Sequence[str] = ("exact", "1km")) -> DataFrame:
    return labels.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(day).isNull().cast("double")).alias("missing_dates"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.avg(F.col(accuracy).isin(*precise).cast("double")).alias("precise_share"),
    )


def coverage_verdict(points: DataFrame, value: str) -> DataFrame:
    """Share of lattice points with data and the word for it."""
    s = F.avg(F.col(value).isNotNull().cast("double"))
    return points.agg(s.alias("share")).withColumn(
        "verdict", F.when(F.col("share") > 0.70, "usable").when(F.col("share") > 0.25, "partial").otherwise("unusable")
    )


def centre_window(cells: DataFrame, value: str, half: int) -> DataFrame:
    """The window around the lattice centre with its min and max."""
    mid = cells.agg(
        F.struct(F.floor((F.min("row") + F.max("row")) / 2).alias("r"), F.floor((F.min("col") + F.max("col")) / 2).alias("c")).alias("m")
    ).scalar()
    x = cells.withColumn("_m", mid).where(
        F.col("row").between(F.col("_m.r") - half, F.col("_m.r") + half) & F.col("col").between(F.col("_m.c") - half, F.col("_m.c") + half)
    )
    return x.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
