"""Satellite scene catalogues: mix, cloud, revisit gaps, datable windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .ranking import percentiles


def scene_mix(scenes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per attribute value for several attributes in one pass."""
    sets = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in cols]))
    return scenes.select(sets.alias("a")).groupBy("a.attribute", "a.value").agg(F.count(F.lit(1)).alias("n"))


def cloud_summary(scenes: DataFrame, cloud: str = "cloud", below: Sequence[int] = (10, 20, 50)) -> DataFrame:
    base = scenes.where(F.col(cloud) >= 0)
    med = percentiles(base, cloud, [0.5]).select("p0").scalar()
    return base.agg(
        F.count(F.lit(1)).alias("n"), F.min(cloud).alias("min"), F.max(cloud).alias("max"),
        *[F.avg((F.col(cloud) < b).cast("double")).alias(f"below_{b}") for b in below],
    ).withColumn("median", med)


def best_per_day(scenes: DataFrame, site: str = "site") -> DataFrame:
    return scenes.groupBy(site, "day").agg(F.min("cloud").alias("cloud"))


def revisit_gaps(scenes: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Gaps between consecutive distinct days per key: median, p90 and longest.

    Distinct days come first, so a busy site's window is as long as the calendar.
    """
    d = scenes.select(*keys, day).distinct()
    gap = F.datediff(day, F.lag(day).over(W.partitionBy(*keys).orderBy(day)))
    g = d.withColumn("gap", gap).where(F.col("gap").isNotNull())
    return g.groupBy(*keys).agg(
        F.percentile("gap", 0.5).alias("median_gap"), F.percentile("gap", 0.9).alias("p90_gap"), F.max("gap").alias("max_gap")
    )


def acquisition_summary(scenes: DataFrame, site: str, period: str) -> DataFrame:
    """Per period: acquisitions, orbit split, and the median over sites of each site's gaps."""
    counts = scenes.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("orbit") == "asc").alias("asc"), F.count_if(F.col("orbit") == "desc").alias("desc")
    )
    per = revisit_gaps(scenes, [period, site])
    med = percentiles(per, "median_gap", [0.5], [period]).select(period, F.col("p0").alias("median_gap"), F.col("n").alias("n_sites"))
    p90 = percentiles(per, "p90_gap", [0.5], [period]).select(period, F.col("p0").alias("p90_gap"))
    return counts.join(med, period, "left").join(p90, period, "left")


def scenes_within(events: DataFrame, scenes: DataFrame, days: int = 120) -> DataFrame:
    """(site, day) event days joined to scenes within +-days, through time buckets.

    Events are first reduced to distinct site-days, and scenes to the clearest per day, so
    a site-day meets at most 2 * days + 1 rows however busy the site is.
    """
    e = events.select("site", "day").distinct()
    b = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / days)
    asked = e.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    s = best_per_day(scenes).select("site", F.col("day").alias("scene_day"), "cloud").withColumn(
        "_b", F.floor(F.datediff("scene_day", F.lit("1970-01-01").cast("date")) / days)
    )
    j = asked.join(s, ["site", "_b"], "left").drop("_b")
    ok = F.col("scene_day").between(F.date_sub("day", days), F.date_add("day", days))
    return j.withColumn("cloud", F.when(ok, F.col("cloud"))).withColumn("scene_day", F.when(ok, F.col("scene_day")))


def bracket_asof(events: DataFrame, scenes: DataFrame, levels: Sequence[int] = (20, 40, 60, 80), days: int = 120) -> DataFrame:
    """Last clear view on or before and first clear view after each site-day, per cloud level.

    The window is NULL where either side is missing.
    """
    j = scenes_within(events, scenes, days)
    before, after = F.col("scene_day") <= F.col("day"), F.col("scene_day") > F.col("day")
    aggs = [F.count("scene_day").alias("n_scenes")]
    for lv in levels:
        clear = F.col("cloud") <= lv
        aggs.append(F.max(F.when(before & clear, F.col("scene_day"))).alias(f"_b{lv}"))
        aggs.append(F.min(F.when(after & clear, F.col("scene_day"))).alias(f"_a{lv}"))
    g = j.groupBy("site", "day").agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(lv).alias("level"), F.datediff("day", f"_b{lv}").alias("gap_before"),
                F.datediff(f"_a{lv}", "day").alias("gap_after"),
            )
            for lv in levels
        ]
    )
    return g.select("site", "day", "n_scenes", F.explode(rows).alias("r")).select(
        "site", "day", "n_scenes", "r.*", (F.col("r.gap_before") + F.col("r.gap_after")).alias("window")
    )


def window_summary(brackets: DataFrame) -> DataFrame:
    """Per cloud level: datable events, exact median window, shares within 7 and 14 days."""
    w = brackets.where(F.col("window").isNotNull())
    med = percentiles(w, "window", [0.5], ["level"]).select("level", F.col("p0").alias("median_window"))
    base = brackets.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_events"), F.count("window").alias("n_both"),
        F.avg((F.col("window") <= 7).cast("double")).alias("within_7"), F.avg((F.col("window") <= 14).cast("double")).alias("within_14"),
    )
    return base.join(med, "level", "left")
