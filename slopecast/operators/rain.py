"""Daily rain series: trailing totals, storms, antecedent index, climatology.

Every per-station window here shares one hash partitioning on the station and one
sort on the day; a station holds one row per day, so a window group is bounded by
the length of the calendar whatever the number of raw readings was.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..config import API_DECAY, ID_CURVES, RAIN_WINDOWS, WET_DAY_MM
from ..functions.classify import break_pct, in_season
from ..session import reused
from .ranking import percentiles, share_below_own_history


def daily_totals(readings: DataFrame, station: str, ts: str, mm: str) -> DataFrame:
    return readings.groupBy(F.col(station).alias("station"), F.to_date(ts).alias("day")).agg(
        F.sum(mm).alias("mm")
    )


def calendar(df: DataFrame, day: str = "day") -> DataFrame:
    """Every day from the first to the last, one row each."""
    return df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("day")
    )


def densify(obs: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Every station x every day between the first and last observed day.

    Only the observed rows are shuffled, by station. Each then writes out the days up to
    the station's next observation (the first also those since the calendar began), so
    the dense series is born partitioned by station and every later window reuses that.
    """
    span = obs.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi")).alias("s")).scalar()
    unique = obs.groupBy("station", "day").agg(F.sum(F.col("mm").cast("double")).alias("mm"))
    w = W.partitionBy("station").orderBy("day")
    ranged = unique.withColumn("_prev", F.lag("day").over(w)).withColumn("_next", F.lead("day").over(w)).withColumn("_s", span)
    first = F.when(F.col("_prev").isNull(), F.col("_s.lo")).otherwise(F.col("day"))
    last = F.coalesce(F.date_sub("_next", 1), F.col("_s.hi"))
    dense = ranged.select(
        "station", F.col("day").alias("_seen"), "mm", F.explode(F.sequence(first, last)).alias("day")
    ).select("station", "day", F.when(F.col("day") == F.col("_seen"), F.col("mm")).alias("mm"))
    return dense if fill is None else dense.fillna(fill, ["mm"])


def _by_day() -> W:
    return W.partitionBy("station").orderBy("day")


def _trailing(n: int) -> W:
    return _by_day().rowsBetween(-(n - 1), 0)


def _cumulated(rain: DataFrame, wet_mm: float = WET_DAY_MM) -> DataFrame:
    """Running rain, running wet days and the day's number: one window pass for all totals.

    A trailing total is then the difference of two running totals, whatever its length;
    a sliding frame would add up every window again at every row.
    """
    mm = F.coalesce("mm", F.lit(0.0))
    upto = _by_day().rowsBetween(W.unboundedPreceding, 0)
    return rain.withColumns({
        "_cum": F.sum(mm).over(upto),
        "_wet": F.sum((mm > wet_mm).cast("long")).over(upto),
        "_n": F.row_number().over(_by_day()),
    })


def _difference(running: str, n: int) -> Column:
    total = F.col(running) - F.coalesce(F.lag(running, n).over(_by_day()), F.lit(0))
    return F.when(F.col("_n") >= n, total)


def _total_columns(windows: Sequence[int]) -> dict[str, Column]:
    return {f"r{n}": F.col("mm") if n == 1 else _difference("_cum", n) for n in windows}


def _peak(n: int) -> Column:
    return F.when(F.row_number().over(_by_day()) >= n, F.max(F.coalesce("mm", F.lit(0.0))).over(_trailing(n)))


def trailing_sums(rain: DataFrame, windows: Sequence[int] = RAIN_WINDOWS) -> DataFrame:
    """r1, r3, ...: NULL until the window is full; a missing day counts as 0 inside."""
    return _cumulated(rain).withColumns(_total_columns(windows)).drop("_cum", "_wet", "_n")


def trailing_max(rain: DataFrame, n: int = 30) -> DataFrame:
    return rain.withColumn(f"rmax_{n}", _peak(n))


def wet_days(rain: DataFrame, n: int = 30, wet_mm: float = WET_DAY_MM) -> DataFrame:
    return _cumulated(rain, wet_mm).withColumn(f"wetdays_{n}", _difference("_wet", n)).drop("_cum", "_wet", "_n")


def antecedent_index(rain: DataFrame, decay: float = API_DECAY, spin_up: int = 30) -> DataFrame:
    """api[t] = mm[t] + decay * api[t-1], without a UDF.

    A decayed sum is a plain running sum of mm * decay^-i. To keep the powers small the series
    is cut into blocks over which the decay comes to 1e-12, however slow it is; each block adds
    the decayed ends of the three before it. What is older weighs under 1e-36, far below what
    a double can hold beside it.
    """
    if not 0 < decay < 1:
        raise ValueError("decay lies between 0 and 1")
    block = max(2, int(12 / -math.log10(decay)))
    indexed = rain.withColumn("_t", F.row_number().over(_by_day()) - 1).withColumn("_b", F.floor(F.col("_t") / block))
    i = F.col("_t") - F.col("_b") * block
    in_block = W.partitionBy("station", "_b").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    weighted = F.coalesce("mm", F.lit(0.0)) * F.pow(F.lit(decay), -i)
    own = indexed.withColumn("_own", F.sum(weighted).over(in_block) * F.pow(F.lit(decay), i))
    by_block = W.partitionBy("station").orderBy("_b")
    carried = F.lit(0.0)
    for k in (3, 2, 1):
        end = F.max_by("_own", "_t").over(by_block.rangeBetween(-k, -k))
        carried = carried + F.coalesce(end, F.lit(0.0)) * decay ** (block * (k - 1))
    api = F.col("_own") + carried * F.pow(F.lit(decay), i + 1)
    return own.withColumn("api", F.when(F.col("_t") >= spin_up - 1, api)).drop("_t", "_b", "_own")


def storms(rain: DataFrame, wet_mm: float = WET_DAY_MM) -> DataFrame:
    """Length and total of the current run of wet days; 0 on a dry day, never NULL."""
    mm = F.coalesce("mm", F.lit(0.0))
    wet = mm > wet_mm
    islands = rain.withColumn("_isl", F.sum((~wet).cast("int")).over(_by_day()))
    run = W.partitionBy("station", "_isl").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return (
        islands.withColumn("storm_dur", F.when(wet, F.sum(wet.cast("int")).over(run)).otherwise(0))
        .withColumn("storm_rain", F.when(wet, F.sum(F.when(wet, mm).otherwise(0.0)).over(run)).otherwise(0.0))
        .drop("_isl")
    )


def id_ratio(dur: Column, total: Column, curve: str = "guzzetti2008") -> Column:
    """Mean storm intensity over the intensity-duration curve; 0 when dry."""
    a, b = ID_CURVES[curve]
    hours = F.greatest(dur, F.lit(1)) * F.lit(24.0)
    return F.when(dur > 0, (total / hours) / (F.lit(a) * F.pow(hours, F.lit(-b)))).otherwise(0.0)


def rain_features(rain: DataFrame, curve: str = "guzzetti2008") -> DataFrame:
    """All eleven per-day features; one shuffle on the station serves them all."""
    base = _cumulated(rain).withColumns(
        {**_total_columns(RAIN_WINDOWS), "rmax_30": _peak(30), "wetdays_30": _difference("_wet", 30)}
    ).drop("_cum", "_wet", "_n")
    out = storms(antecedent_index(base))
    return out.withColumn("storm_id_ratio", id_ratio(F.col("storm_dur"), F.col("storm_rain"), curve))


def storm_stats(features: DataFrame) -> DataFrame:
    live = F.col("storm_dur") > 0
    return features.agg(
        F.avg((F.col("storm_id_ratio") > 1.0).cast("int")).alias("share_over_curve"),
        F.avg(live.cast("int")).alias("share_in_storm"),
        F.avg(F.when(live, F.col("storm_dur"))).alias("mean_dur"),
        F.max("storm_dur").alias("max_dur"),
        F.avg(F.when(live, F.col("storm_rain"))).alias("mean_rain"),
        F.max("storm_rain").alias("max_rain"),
    )


def date_features(days: DataFrame) -> DataFrame:
    angle = F.lit(2.0 * 3.141592653589793) * F.dayofyear("day") / F.lit(365.25)
    return days.select(
        "day",
        F.year("day").alias("year"),
        F.month("day").alias("month"),
        F.dayofyear("day").alias("doy"),
        in_season(F.col("day")).cast("int").alias("monsoon"),
        F.sin(angle).alias("doy_sin"),
        F.cos(angle).alias("doy_cos"),
    )


def join_climate_index(dates: DataFrame, oni: DataFrame) -> DataFrame:
    return dates.join(oni, ["year", "month"], "left")


def mean_annual(rain: DataFrame) -> DataFrame:
    """Mean yearly total per station; partial sums per (station, year) first."""
    yearly = rain.groupBy("station", F.year("day").alias("year")).agg(F.sum("mm").alias("total"))
    return yearly.groupBy("station").agg((F.sum("total") / F.count("year")).alias("annual_mm"))


def latitude_bands(annual: DataFrame, stations: DataFrame, width: float) -> DataFrame:
    return (
        annual.join(stations, "station")
        .groupBy(F.floor(F.col("lat") / width).alias("band"))
        .agg(F.avg("annual_mm").alias("band_mm"), F.count(F.lit(1)).alias("n_stations"))
    )


def south_north_ratio(annual: DataFrame, stations: DataFrame) -> DataFrame:
    """Mean of the southern half over the northern half, and the wettest station."""
    located = annual.join(stations, "station")
    mid = stations.agg(((F.min("lat") + F.max("lat")) / 2).alias("m")).scalar()
    s = F.avg(F.when(F.col("lat") < F.col("_mid"), F.col("annual_mm")))
    n = F.avg(F.when(F.col("lat") >= F.col("_mid"), F.col("annual_mm")))
    return located.withColumn("_mid", mid).agg(
        (s / n).alias("south_over_north"),
        F.min_by("station", F.struct((-F.col("annual_mm")).alias("m"), F.col("station"))).alias("wettest"),
        F.max("annual_mm").alias("wettest_mm"),
    )


def monthly_mean(rain: DataFrame) -> DataFrame:
    return rain.groupBy(F.month("day").alias("month")).agg(F.avg("mm").alias("mean_mm"))


def season_totals(rain: DataFrame) -> DataFrame:
    return rain.where(in_season(F.col("day"))).groupBy("station").agg(F.sum("mm").alias("season_mm"))


def daily_spread(rain: DataFrame) -> DataFrame:
    return rain.groupBy("day").agg(F.avg("mm").alias("mean_mm"), F.max("mm").alias("max_mm"))


def season_peak_rank(rolled: DataFrame, value: str = "r7") -> DataFrame:
    """Largest 7-day total of each season, averaged over stations; rank and z per year.

    The windows run over one row per year.
    """
    peaks = (
        rolled.where(in_season(F.col("day")))
        .groupBy("station", F.year("day").alias("year"))
        .agg(F.max(value).alias("peak"))
        .groupBy("year")
        .agg(F.avg("peak").alias("mean_peak"))
    )
    years = W.partitionBy(F.lit(1))
    return peaks.select(
        "year",
        "mean_peak",
        F.rank().over(years.orderBy(F.desc("mean_peak"))).alias("rank"),
        (
            (F.col("mean_peak") - F.avg("mean_peak").over(years)) / F.stddev_pop("mean_peak").over(years)
        ).alias("z"),
    )


def timeline(rain: DataFrame) -> DataFrame:
    return rain.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(
        F.countDistinct("day").alias("days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.avg(F.col("mm").isNull().cast("int")).alias("null_share"),
    )


def compare_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ratio of means, both 90th percentiles and the correlation over shared days."""
    pair = a.select("station", "day", F.col("mm").alias("a")).join(
        b.select("station", "day", F.col("mm").alias("b")), ["station", "day"]
    )
    pair = reused(pair)
    base = pair.agg(
        (F.avg("a") / F.avg("b")).alias("mean_ratio"), F.corr("a", "b").alias("correlation"), F.count(F.lit(1)).alias("n")
    )
    return base.withColumn("p90_a", percentiles(pair, "a", [0.9]).select("p0").scalar()).withColumn(
        "p90_b", percentiles(pair, "b", [0.9]).select("p0").scalar()
    )


def feature_redundancy(features: DataFrame, name: str, totals: Sequence[str]) -> DataFrame:
    """Correlation of one feature with each trailing total, one pass."""
    wide = features.agg(*[F.corr(name, t).alias(t) for t in totals])
    return wide.unpivot([], list(totals), "total", "correlation")


def series_stats(df: DataFrame, cell: str, step: str, value: str, every: int = 1) -> DataFrame:
    """Peak, mean and sum of a gridded series per cell, over every k-th step."""
    return df.where(F.pmod(F.col(step), F.lit(every)) == 0).groupBy(cell).agg(
        F.max(value).alias("peak"), F.avg(value).alias("mean"), F.sum(value).alias("total")
    )


def peak_by_lead(df: DataFrame, issued: str, day: str, value: str) -> DataFrame:
    return df.groupBy(F.datediff(day, issued).alias("lead")).agg(F.max(value).alias("peak"))


# --- unusual-for-here percentiles -------------------------------------------------


def season_percentiles(rolled: DataFrame, features: Sequence[str] = ("r3", "r7")) -> DataFrame:
    """Each season day's share strictly below in the station's own season history."""
    out = rolled.where(in_season(F.col("day")) & F.col(features[-1]).isNotNull())
    for f in features:
        out = share_below_own_history(out, "station", f, f"{f}_pct")
    return out


def trigger(rolled: DataFrame, features: Sequence[str] = ("r3", "r7")) -> DataFrame:
    """Mean of the season percentiles of the trailing totals."""
    pct = season_percentiles(rolled, features)
    total = sum((F.col(f"{f}_pct") for f in features[1:]), F.col(f"{features[0]}_pct"))
    return pct.select("station", "day", (total / F.lit(float(len(features)))).alias("trigger"))


def climatology(rolled: DataFrame, features: Sequence[str] = ("r3", "r7"), points: int = 101) -> DataFrame:
    """Breakpoints 0..100 % per station and feature over its season days.

    ``percentile`` keeps a station's distinct values in memory: bounded by its days.
    """
    season = rolled.where(in_season(F.col("day")))
    grid = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    wide = season.groupBy("station").agg(*[F.percentile(f, grid).alias(f) for f in features])
    return wide.unpivot(["station"], list(features), "feature", "breaks")


def trigger_from_breaks(rolled: DataFrame, clim: DataFrame, features: Sequence[str] = ("r3", "r7")) -> DataFrame:
    """Live scoring: percentiles from stored breakpoints, averaged over the features."""
    wide = clim.groupBy("station").pivot("feature", list(features)).agg(F.first("breaks"))
    named = wide.select("station", *[F.col(f).alias(f"{f}_breaks") for f in features])
    scored = rolled.join(named, "station")
    parts = [break_pct(F.col(f), F.col(f"{f}_breaks")) for f in features]
    total = sum(parts[1:], parts[0])
    return scored.select("station", "day", (total / F.lit(float(len(parts)))).alias("trigger"))


def holdout_trigger(rolled: DataFrame, first_held_year: int) -> DataFrame:
    """Trigger of the held-out years, scored against a climatology of the years before."""
    before, after = F.year("day") < first_held_year, F.year("day") >= first_held_year
    rolled = reused(rolled)
    return trigger_from_breaks(rolled.where(after & in_season(F.col("day"))), climatology(rolled.where(before)))


def forecast_days(rain: DataFrame, today: Column, n: int = 7) -> DataFrame:
    """The next ``n`` days from ``today``; when there are none, the last ``n`` days.

    Works on distinct days (one row per day), so the window is small by construction.
    """
    days = rain.select("day").distinct().withColumn("ahead", (F.col("day") >= today).cast("int"))
    w = W.partitionBy("ahead")
    ranked = days.withColumn(
        "k",
        F.when(F.col("ahead") == 1, F.row_number().over(w.orderBy("day"))).otherwise(
            F.row_number().over(w.orderBy(F.desc("day")))
        ),
    ).withColumn("any_ahead", F.max("ahead").over(W.partitionBy(F.lit(1))))
    return ranked.where((F.col("k") <= n) & (F.col("ahead") == F.col("any_ahead"))).select("day")
