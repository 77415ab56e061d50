"""Streams of readings: daily totals, trailing windows, wet spells, alerts, state.

Every function takes a (streaming or batch) DataFrame of readings (station, ts, mm,
reading_id) and returns a DataFrame, so each has a batch twin to be checked against.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import API_DECAY, TRIGGER_BREAKS, WET_DAY_MM
from ..functions.classify import break_pct, classify
from ..session import scratch_path


def run_deliveries(start: Callable, coming: Iterable[Callable] = ()) -> None:
    """Run a query over everything available, and again after each delivery that is to come."""
    start().awaitTermination()
    for deliver in coming:
        deliver()
        start().awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str = "append", coming: Iterable[Callable] = ()) -> DataFrame:
    """Run a stream over everything available, then over each delivery of ``coming``, and return what it wrote.

    Results and progress go to the shared folder, so a restarted query resumes.
    """
    spark = stream.sparkSession
    out, progress = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-progress")
    run_deliveries(
        lambda: stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        .outputMode(mode).trigger(availableNow=True).start(),
        coming,
    )
    return spark.read.schema(stream.schema).parquet(out)


def daily_totals(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """One total per station and day; readings later than the watermark are dropped."""
    return (
        readings.withWatermark("ts", late).groupBy("station", F.window("ts", "1 day").alias("w"))
        .agg(F.sum("mm").alias("mm")).select("station", F.to_date("w.start").alias("day"), "mm")
    )


def trailing_totals(readings: DataFrame, days: int, late: str = "2 days") -> DataFrame:
    """Sliding totals ending on each day, stepping one day."""
    return (
        readings.withWatermark("ts", late).groupBy("station", F.window("ts", f"{days} days", "1 day").alias("w"))
        .agg(F.sum("mm").alias("mm")).select("station", F.date_sub(F.to_date("w.end"), 1).alias("day"), "mm")
    )


def wet_spells(daily: DataFrame, wet_mm: float = WET_DAY_MM, late: str = "2 days") -> DataFrame:
    """Runs of wet days: a spell ends when a whole day passes without one. ``daily`` has one row per day."""
    return (
        daily.where(F.col("mm") > wet_mm).withWatermark("ts", late)
        .groupBy("station", F.session_window("ts", "1 day").alias("w"))
        .agg(F.sum("mm").alias("mm"), F.count(F.lit(1)).alias("days"))
        .select("station", F.to_date("w.start").alias("first_day"), "days", "mm")
    )


def without_redeliveries(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """A reading delivered again inside the watermark is dropped; state is one key per reading."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["reading_id"])


def alert_feed(daily: DataFrame, climatology: DataFrame) -> DataFrame:
    """Each station-day against its stored breakpoints: percentile and class (stream-static join)."""
    c = climatology.select("station", "breaks")
    pct = break_pct(F.col("mm"), F.col("breaks"))
    j = daily.join(c, "station").withColumn("pct", pct)
    return j.select("station", "day", "mm", "pct", classify(F.col("pct"), TRIGGER_BREAKS).alias("cls"))


def append_alerts(feed: DataFrame, path: str, progress: str):
    """Append alerts through ``foreachBatch``; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def carried_index(daily: DataFrame, decay: float = API_DECAY, keep_days: int = 365, late: str = "2 days") -> DataFrame:
    """Antecedent index with one float and one date of state per station.

    A gap of n days without a row decays the carried value n times. A day that arrives after
    a later one adds what is left of it by then, and its row carries the corrected index of
    that later day. The state of a station goes ``keep_days`` after its last day, once the
    watermark has passed; by then decay**keep_days is left of it.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(frames)).sort_values("day")
        out = []
        for day, mm in zip(rows["day"], rows["mm"]):
            n = pd.Timestamp(day).toordinal()
            new = 0.0 if mm is None or pd.isna(mm) else float(mm)
            if last is not None and n < last:
                value += new * decay ** (last - n)
                day = date.fromordinal(last)
            else:
                value = new + value * (1.0 if last is None else decay ** (n - last))
                last = n
            out.append((key[0], day, value))
        state.update((value, last))
        expires = (pd.Timestamp(date.fromordinal(last)) + pd.Timedelta(days=keep_days)).value // 1_000_000
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["station", "day", "api"])

    timed = daily.withColumn("_ts", F.col("day").cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy("station").applyInPandasWithState(
        step, "station long, day date, api double", "value double, last long", "append", "EventTimeTimeout"
    )


def corrected_index(daily: DataFrame, decay: float = API_DECAY, window: int = 30, late: str = "30 days") -> DataFrame:
    """Antecedent index that late days correct: (station, day, api, version).

    A station's state is the index at the end of the day ``window`` days before its last one and
    the rain of the days since. A day that arrives late is put where it belongs, and it and
    every kept day after it come out again with a higher ``version``; :func:`latest` keeps one
    row per station and day. A day from before the kept ones still decays into all of them, but
    has no row of its own. Rows of one day are added up, a null counts as 0, and ``late`` is how
    far behind a row may arrive at all.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        base, first, days, rain, version = state.get if state.exists else (0.0, None, [], [], 0)
        kept = dict(zip(days, rain, strict=True))
        rows = pd.concat(list(frames))
        news = zip((pd.Timestamp(d).toordinal() for d in rows["day"]), rows["mm"].fillna(0.0).astype(float), strict=True)
        changed = None
        for n, mm in news:
            if first is not None and n <= first:
                base += mm * decay ** (first - n)
            else:
                kept[n] = kept.get(n, 0.0) + mm
            changed = n if changed is None else min(changed, n)
        version += 1
        out, value, before, cut = [], base, first, max(kept, default=first) - window
        new_base, new_first = base, first
        for n in sorted(kept):
            value = kept[n] + (value * decay ** (n - before) if before is not None else 0.0)
            before = n
            if n >= changed:
                out.append((key[0], date.fromordinal(n), value, version))
            if n <= cut:
                new_base, new_first = value, n
        days = [n for n in sorted(kept) if n > cut]
        state.update((new_base, new_first, days, [kept[n] for n in days], version))
        expires = (pd.Timestamp(date.fromordinal(before)) + pd.Timedelta(days=365)).value // 1_000_000
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["station", "day", "api", "version"])

    timed = daily.withColumn("_ts", F.col("day").cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy("station").applyInPandasWithState(
        step, "station long, day date, api double, version long", "base double, first long, days array<long>, rain array<double>, version long", "append", "EventTimeTimeout"
    )


def latest(revised: DataFrame, keys: Sequence[str] = ("station", "day"), version: str = "version") -> DataFrame:
    """The last version of each key of an append-only table of corrections."""
    rest = [c for c in revised.columns if c not in (*keys, version)]
    return revised.groupBy(*keys).agg(*[F.max_by(c, version).alias(c) for c in rest])


def match_outcomes(forecasts: DataFrame, outcomes: DataFrame, within: str = "7 days", late: str = "2 days") -> DataFrame:
    """Forecasts joined to outcomes at the same station inside the window that follows.

    Both sides carry watermarks, so state on either side is dropped once it cannot match.
    """
    f = forecasts.withWatermark("issued", late)
    o = outcomes.withColumnRenamed("station", "o_station").withWatermark("happened", late)
    near = (F.col("station") == F.col("o_station")) & (F.col("happened") >= F.col("issued")) & (
        F.col("happened") <= F.col("issued") + F.expr(f"INTERVAL {within}")
    )
    return f.join(o, near)


def counted_outcomes(forecasts: DataFrame, outcomes: DataFrame, within: str = "7 days", late: str = "2 days") -> DataFrame:
    """(station, matches): how many pairs of a forecast and an outcome within ``within`` after it each run has found.

    A run adds its new pairs, so the sum over runs is the count; no pair is ever written. A
    station's state is the times of forecasts and outcomes that later rows can still match,
    which the watermark bounds, and new times are counted against them by binary search.
    """
    reach, slack = (pd.Timedelta(x).value // 1000 for x in (within, late))  # microseconds

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True)
        at = rows["at"].astype("datetime64[us]").astype("int64").to_numpy()
        new_f, new_o = np.sort(at[rows["kind"].to_numpy() == 0]), np.sort(at[rows["kind"].to_numpy() == 1])
        old_f, old_o = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [])))

        def pairs(f: np.ndarray, o: np.ndarray) -> int:
            """Pairs of f with an o in [f, f + reach]; both are sorted."""
            return int((np.searchsorted(o, f + reach, "right") - np.searchsorted(o, f, "left")).sum())

        f, o = np.sort(np.concatenate((old_f, new_f))), np.sort(np.concatenate((old_o, new_o)))
        found = pairs(new_f, o) + pairs(old_f, new_o)
        seen = max(int(at.max()), state.getCurrentWatermarkMs() * 1000)
        state.update((f[f >= seen - reach - slack].tolist(), o[o >= seen - slack].tolist()))
        state.setTimeoutTimestamp((seen + reach + slack) // 1000 + 1)
        yield pd.DataFrame({"station": [key[0]], "matches": [found]})

    sides = [df.select("station", F.col(c).alias("at"), F.lit(k).alias("kind")) for k, (df, c) in enumerate(((forecasts, "issued"), (outcomes, "happened")))]
    both = sides[0].unionByName(sides[1]).withWatermark("at", late)
    return both.groupBy("station").applyInPandasWithState(
        step, "station long, matches long", "issued array<long>, happened array<long>", "append", "EventTimeTimeout"
    )
