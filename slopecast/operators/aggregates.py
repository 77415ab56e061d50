"""Summaries: histograms, shares, coverage, thresholds, densities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .ranking import percentiles


def value_counts(df: DataFrame, c: str, k: int | None = None) -> DataFrame:
    """Counts per value, NULL as 'unknown'; ``k`` makes it a top-k report."""
    out = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")).count()
    return out if k is None else out.orderBy(F.desc("count"), "value").limit(k)


def histogram(df: DataFrame, v: Column, lo: float, hi: float, n: int) -> DataFrame:
    """Equal-width bins over a fixed range: outside dropped, last bin closed, empty bins kept."""
    width = (hi - lo) / n
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(n - 1)).cast("int")
    counted = df.where(v.between(lo, hi)).select(b.alias("bin"), F.lit(1).alias("one"))
    empty = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"), F.lit(0).alias("one"))
    return counted.unionByName(empty).groupBy("bin").agg(F.sum("one").alias("n"))


def clipped_histogram(df: DataFrame, c: str, n: int, p_lo: float = 0.01, p_hi: float = 0.99) -> DataFrame:
    """Histogram after clipping to two exact percentiles, with each bin's left edge."""
    ends = percentiles(df, c, [p_lo, p_hi]).select(F.struct("p0", "p1").alias("e")).scalar()
    x = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("v")).withColumn("_e", ends)
    clipped = F.least(F.greatest(F.col("v"), F.col("_e.p0")), F.col("_e.p1"))
    width = (F.col("_e.p1") - F.col("_e.p0")) / n
    b = F.when(width > 0, F.least(F.floor((clipped - F.col("_e.p0")) / width), F.lit(n - 1))).otherwise(0).cast("int")
    return x.groupBy(b.alias("bin"), (F.col("_e.p0") + b * width).alias("left_edge")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, c: str) -> DataFrame:
    """min, max, mean, population deviation and count in one pass; exact median beside it."""
    base = df.agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std"), F.count(c).alias("n"),
    )
    return base.withColumn("median", percentiles(df, c, [0.5]).select("p0").scalar())


def share_over(df: DataFrame, c: str, cuts: Sequence[float]) -> DataFrame:
    return df.where(F.col(c).isNotNull()).agg(
        *[F.avg((F.col(c) > t).cast("double")).alias(f"over_{t:g}".replace(".", "_")) for t in cuts]
    )


def class_share(df: DataFrame, c: str, floor_share: float = 0.0) -> DataFrame:
    """Count and share per class; classes under ``floor_share`` are folded into one row with a NULL class.

    The total comes from the class counts themselves, so shares add up to 1.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(c).count()
    total = F.sum("count").over(W.partitionBy(F.lit(1)))
    each = counts.select(c, "count", total.alias("_t"))
    named = F.when(F.col("count") / F.col("_t") >= floor_share, F.col(c)).alias(c)
    return each.groupBy(named).agg(F.sum("count").alias("count"), (F.sum("count") / F.max("_t")).alias("share"))


def threshold_table(df: DataFrame, attr: str, length: str, cuts: Sequence[float]) -> DataFrame:
    """Count, share and length above each threshold; conditional sums, so no row is copied."""
    parts = []
    for t in cuts:
        over = F.col(attr) > t
        parts.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.count_if(over).alias("n"),
                (F.count_if(over) / F.count(attr)).alias("share"),
                F.coalesce(F.sum(F.when(over, F.col(length))), F.lit(0.0)).alias("length"),
            )
        )
    return df.agg(F.array(*parts).alias("t")).select(F.explode("t").alias("t")).select("t.*")


def missing_report(df: DataFrame, floats: Sequence[str], codes: Sequence[str], limit: float = 0.02) -> DataFrame:
    """Missing share per column: NULL for measurements, 0 for categories."""
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in floats]
    aggs += [F.avg((F.coalesce(F.col(c), F.lit(0)) == 0).cast("double")).alias(c) for c in codes]
    wide = df.agg(*aggs)
    return wide.unpivot([], [*floats, *codes], "column", "missing").withColumn(
        "flagged", (F.col("missing") > limit).cast("int")
    )


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "layer", "coverage")


def zonal_mean(all_zones: DataFrame, cells: DataFrame, zone: str, aggs: Mapping[str, Column]) -> DataFrame:
    """Aggregates per zone; zones without cells keep NULL."""
    return all_zones.join(cells.groupBy(zone).agg(*[e.alias(k) for k, e in aggs.items()]), zone, "left")


def weighted_share(df: DataFrame, cls: str, weight: str) -> DataFrame:
    """Weight per class and its share; class 0 (not assessed) is left out, not counted as safe."""
    per = df.where(F.col(cls) > 0).groupBy(cls).agg(F.sum(weight).alias("total"))
    return per.withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy(F.lit(1))))


def distinct_days(df: DataFrame, key: str, day: str) -> DataFrame:
    """Distinct days per key: deduplicate first, so a hot key shuffles one row per day."""
    return df.select(key, day).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_days"))


def by_decade(df: DataFrame, day: str) -> DataFrame:
    dec = (F.floor(F.year(day) / 10) * 10).cast("int").alias("decade")
    return df.groupBy(dec).agg(F.count(F.lit(1)).alias("n"))


def season_contrast(df: DataFrame, key: Sequence[str], value: str, below: float, monsoon=(5, 9), dry=(11, 3)) -> DataFrame:
    """n, exact median and share below a threshold for the wet and the dry window."""
    m = F.month("day")
    season = F.when(m.between(*monsoon), "monsoon").when((m >= dry[0]) | (m <= dry[1]), "dry")
    tagged = df.withColumn("season", season).where(F.col("season").isNotNull())
    med = percentiles(tagged, value, [0.5], by=[*key, "season"]).select(*key, "season", F.col("p0").alias("median"))
    base = tagged.groupBy(*key, "season").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(value) < below).cast("double")).alias("share_below")
    )
    return base.join(med, [*key, "season"], "left")


def high_share(df: DataFrame, day: str, cls: str, level: int = 4) -> DataFrame:
    """Per day: assessed cells at or above a class, over assessed cells."""
    return df.where(F.col(cls) > 0).groupBy(day).agg(F.avg((F.col(cls) >= level).cast("double")).alias("high_share"))


def statewide_alerts(trig: DataFrame, level: float) -> DataFrame:
    """Days per year on which any point reaches the level."""
    days = trig.groupBy("day").agg(F.max("trigger").alias("top"))
    return days.groupBy(F.year("day").alias("year")).agg(
        F.count_if(F.col("top") >= level).alias("alert_days"), F.count(F.lit(1)).alias("days")
    )


def alerts_and_capture(trig: DataFrame, event_trig: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Share of point-days at or above each level, share of events caught, and the lift."""
    def wide(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(
            F.array(*[F.avg((F.col("trigger") >= c).cast("double")) for c in cuts]).alias(tag)
        )

    both = wide(trig, "alert").withColumn("capture", wide(event_trig, "capture").scalar())
    lv = F.array(*[F.lit(float(c)) for c in cuts]).alias("threshold")
    z = both.select(F.explode(F.arrays_zip(lv, "alert", "capture")).alias("z")).select("z.*")
    lift = F.when(F.col("alert") > 0, F.col("capture") / F.col("alert")).otherwise(0.0)
    return z.select("threshold", F.col("alert").alias("alert_share"), F.col("capture"), lift.alias("lift"))


def band_table(df: DataFrame, value: str, width: float, predicted: Column, actual: Column) -> DataFrame:
    """Share of the domain, of predicted-high and of actual positives per value band."""
    band = (F.floor(F.col(value) / width) * width).alias("band")
    per = df.groupBy(band).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(predicted).alias("n_pred"), F.count_if(actual).alias("n_act")
    )
    all_ = W.partitionBy(F.lit(1))
    return per.select(
        "band",
        *[(F.col(c) / F.sum(c).over(all_)).alias(o) for c, o in
          (("n", "domain_share"), ("n_pred", "predicted_share"), ("n_act", "actual_share"))],
    )


def populated(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], list(cols), "attribute", "n")


def rollup_counts(df: DataFrame, group: str, aggs: Mapping[str, Column]) -> DataFrame:
    """Per group plus a grand total row, in one pass."""
    return df.rollup(group).agg(F.grouping(group).alias("is_total"), *[e.alias(k) for k, e in aggs.items()]).withColumn(
        group, F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col(group))
    ).drop("is_total")
