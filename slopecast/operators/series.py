"""All daily rain features of a station in one sorted pass.

Observed days are shuffled by station and sorted once. A task fills the calendar and lays many
stations side by side as a matrix of days by stations: totals are differences of running totals,
a sliding maximum doubles its reach step by step, and what depends on the day before (decayed
index, storm runs) walks down the days once, for all stations of the matrix together. The
measures are those of the window functions in :mod:`rain`, without a window chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import API_DECAY, ID_CURVES, RAIN_WINDOWS, WET_DAY_MM

FIELDS = 1 << 20  # station-days of one matrix


def _totals(x: np.ndarray, n: int) -> np.ndarray:
    """Trailing sums of ``n`` days (axis 0), NaN until the window is full."""
    running = np.zeros((len(x) + 1, x.shape[1]))
    np.cumsum(x, axis=0, out=running[1:])
    out = np.full(x.shape, np.nan)
    out[n - 1 :] = running[n:] - running[: len(running) - n]
    return out


def _peak(x: np.ndarray, n: int) -> np.ndarray:
    """Trailing maxima of ``n`` days: windows of 1, 2, 4, ... days, and two overlapping ones at last."""
    out = np.full(x.shape, np.nan)
    if len(x) < n:
        return out
    now, k = x, 1
    while 2 * k <= n:
        now = np.maximum(now[k:], now[:-k])
        k *= 2
    out[n - 1 :] = np.maximum(now[n - k :], now[: len(now) - (n - k)]) if n > k else now
    return out


def measures(
    mm: np.ndarray, windows: Sequence[int], peak: int | None, wet_window: int | None, decay: float | None, spin_up: int, curve: str | None, wet_mm: float
) -> dict[str, np.ndarray]:
    """Columns of a (days, stations) matrix; NaN where a value is not defined yet."""
    out = {f"r{n}": mm if n == 1 else _totals(mm, n) for n in windows}
    if peak:
        out[f"rmax_{peak}"] = _peak(mm, peak)
    wet = mm > wet_mm
    if wet_window:
        out[f"wetdays_{wet_window}"] = _totals(wet.astype(np.float64), wet_window)
    if decay is not None:
        api, last = np.empty(mm.shape), np.zeros(mm.shape[1])
        for t in range(len(mm)):
            last = np.add(mm[t], decay * last, out=api[t])
        api[: spin_up - 1] = np.nan
        out["api"] = api
    if curve:
        dur, total = np.zeros(mm.shape), np.zeros(mm.shape)
        for t in range(len(mm)):
            if t:
                np.add(dur[t - 1], 1, out=dur[t])
                np.add(total[t - 1], mm[t], out=total[t])
            else:
                dur[t], total[t] = 1, mm[t]
            dur[t] *= wet[t]
            total[t] *= wet[t]
        a, b = ID_CURVES[curve]
        hours = np.maximum(dur, 1) * 24.0
        out |= {"storm_dur": dur, "storm_rain": total, "storm_id_ratio": np.where(dur > 0, (total / hours) / (a * hours**-b), 0.0)}
    return out


Matrix = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, dict[str, pa.Array]]]]


def _over_matrices(obs: DataFrame, fields: dict[str, pa.DataType], ddl: str, work: Matrix) -> DataFrame:
    """``station`` and what ``work`` makes of matrices of days by stations.

    ``work`` is given the calendar (days since 1970) and the matrix, and yields, as often as it
    likes, the column number of each row's station and the row's values.
    """
    known = obs.where("station is not null and day is not null").select("station", F.to_date("day").alias("day"), F.col("mm").cast("double").alias("mm"))
    unique = known.groupBy("station", "day").agg(F.coalesce(F.sum("mm"), F.lit(0.0)).alias("mm"))
    span = known.agg(F.struct(F.unix_date(F.min("day")).alias("lo"), F.unix_date(F.max("day")).alias("hi")).alias("s")).scalar()
    sent = unique.withColumn("_s", span).select("station", F.unix_date("day").alias("_d"), "mm", F.col("_s.lo").alias("_lo"), F.col("_s.hi").alias("_hi"))

    def answer(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Results for the whole stations in ``t``, sorted by station and day."""
        station = t["station"].combine_chunks().dictionary_encode()
        code, day, mm = (np.asarray(x) for x in (station.indices, t["_d"], t["mm"]))
        lo, days = t["_lo"][0].as_py(), t["_hi"][0].as_py() - t["_lo"][0].as_py() + 1
        n = len(station.dictionary)
        step = max(1, FIELDS // days)
        first = np.searchsorted(code, np.arange(n + 1))
        for s in range(0, n, step):
            e = min(n, s + step)
            mine = slice(first[s], first[e])
            x = np.zeros((days, e - s))
            x[day[mine] - lo, code[mine] - s] = mm[mine]
            for which, cols in work(np.arange(lo, lo + days, dtype=np.int32), x):
                yield pa.RecordBatch.from_arrays([station.dictionary.take(pa.array(which + s)), *(cols[f].cast(k) for f, k in fields.items())], names=["station", *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= FIELDS // 8 and b.column(0)[0] != b.column(0)[-1]:
                t = pa.Table.from_batches(held)
                last = t["station"][-1]
                k = t.num_rows - 1
                while t["station"][k - 1] == last:
                    k -= 1
                yield from answer(t.slice(0, k))
                held, rows = t.slice(k).to_batches(), t.num_rows - k
        if held:
            yield from answer(pa.Table.from_batches(held))

    schema = f"station {obs.schema['station'].dataType.simpleString()}, {ddl}"
    return sent.repartition("station").sortWithinPartitions("station", "_d").mapInArrow(run, schema)


def _flat(m: np.ndarray) -> pa.Array:
    """A (days, stations) matrix station by station; NaN is null."""
    return pa.array(m.T.ravel(), from_pandas=True)


def _rows(calendar: np.ndarray, stations: int) -> tuple[np.ndarray, pa.Array]:
    return np.repeat(np.arange(stations), len(calendar)), pa.array(np.tile(calendar, stations)).cast(pa.date32())


def rain_series(
    obs: DataFrame, windows: Sequence[int] = RAIN_WINDOWS, peak: int | None = 30, wet_window: int | None = 30, decay: float | None = API_DECAY,
    spin_up: int = 30, curve: str | None = "guzzetti2008", wet_mm: float = WET_DAY_MM,
) -> DataFrame:
    """Every station x every day of the common calendar with ``mm`` and the features asked for.

    ``obs``: (station, day, mm); several rows of a station and day are added up, a day without
    one, or with a null, has 0. Windows are NULL until full, ``api`` until ``spin_up`` days have
    passed; storms are 0 on a dry day. A row without station or day is left out. A matrix holds
    some 2^20 station-days, so memory is bounded by one station's calendar.
    """
    if decay is not None and not 0 < decay < 1:
        raise ValueError("decay lies between 0 and 1")
    names = list(measures(np.zeros((1, 1)), windows, peak, wet_window, decay, spin_up, curve, wet_mm))
    whole = {"storm_dur", f"wetdays_{wet_window}"}
    fields = {"day": pa.date32(), "mm": pa.float64()} | {n: pa.int32() if n in whole else pa.float64() for n in names}
    ddl = "day date, mm double" + "".join(f", {n} {'int' if n in whole else 'double'}" for n in names)

    def work(calendar: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        which, day = _rows(calendar, x.shape[1])
        cols = measures(x, windows, peak, wet_window, decay, spin_up, curve, wet_mm)
        yield which, {"day": day, "mm": _flat(x)} | {n: _flat(v) for n, v in cols.items()}

    return _over_matrices(obs, fields, ddl, work)


# --- unusual for here


def _season(calendar: np.ndarray, first: int, last: int) -> np.ndarray:
    month = calendar.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) % 12 + 1
    return (month >= first) & (month <= last)


def _below(history: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many of a station's sorted ``history`` lie strictly below each of its values (both by column)."""
    return np.stack([np.searchsorted(h, v) for h, v in zip(history.T, values.T, strict=True)], 1) if values.size else np.zeros(values.shape, np.int64)


def _breaks(history: np.ndarray, points: int) -> np.ndarray:
    """Linearly interpolated percentiles 0..100 % of sorted columns; NaN of an empty history."""
    if not len(history):
        return np.full((points, history.shape[1]), np.nan)
    at = np.array([i / (points - 1) for i in range(points)]) * (len(history) - 1)
    lo, hi = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    return history[lo] + (history[hi] - history[lo]) * (at - lo)[:, None]


def season_history(obs: DataFrame, windows: Sequence[int] = (3, 7), first: int = 5, last: int = 10) -> DataFrame:
    """Season days with the trailing totals and each total's share strictly below in the station's own season history.

    (station, day, mm, r3, r7, r3_pct, r7_pct) for the days of months ``first`` to ``last`` on
    which the longest window is full.
    """
    names = [f"r{n}" for n in windows] + [f"r{n}_pct" for n in windows]
    fields = {"day": pa.date32(), "mm": pa.float64()} | {n: pa.float64() for n in names}

    def work(calendar: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        live = _season(calendar, first, last) & (np.arange(len(calendar)) >= max(windows) - 1)
        which, day = _rows(calendar[live], x.shape[1])
        cols = {"day": day, "mm": _flat(x[live])}
        for n in windows:
            v = _totals(x, n)[live]
            cols |= {f"r{n}": _flat(v), f"r{n}_pct": _flat(_below(np.sort(v, axis=0), v) / max(1, len(v)))}
        yield which, cols

    return _over_matrices(obs, fields, "day date, mm double" + "".join(f", {n} double" for n in names), work)


def season_trigger(obs: DataFrame, windows: Sequence[int] = (3, 7)) -> DataFrame:
    """(station, day, trigger): the mean share over the trailing totals, on season days."""
    total = sum((F.col(f"r{n}_pct") for n in windows[1:]), F.col(f"r{windows[0]}_pct"))
    return season_history(obs, windows).select("station", "day", (total / F.lit(float(len(windows)))).alias("trigger"))


def season_breaks(obs: DataFrame, windows: Sequence[int] = (3, 7), points: int = 101, first: int = 5, last: int = 10) -> DataFrame:
    """(station, r3, r7): percentiles 0..100 % of each trailing total over the station's season days."""
    fields = {f"r{n}": pa.list_(pa.float64()) for n in windows}

    def work(calendar: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        live, cols = _season(calendar, first, last), {}
        for n in windows:
            b = _breaks(np.sort(_totals(x, n)[live & (np.arange(len(x)) >= n - 1)], axis=0), points)
            cols[f"r{n}"] = pa.array(list(b.T), pa.list_(pa.float64())) if not np.isnan(b).any() else pa.nulls(x.shape[1], pa.list_(pa.float64()))
        yield np.arange(x.shape[1]), cols

    return _over_matrices(obs, fields, ", ".join(f"r{n} array<double>" for n in windows), work)


def live_series(
    obs: DataFrame, start: date | None = None, days: int | None = None, windows: Sequence[int] = (3, 7), points: int = 101, first: int = 5, last: int = 10
) -> DataFrame:
    """(station, day, mm, r3, r7, trigger): each day's totals against the breakpoints of the station's season history.

    A total's share is the number of breakpoints strictly below it over ``points`` - 1, at most 1;
    the trigger is their mean, NULL until every window is full. With ``start`` and ``days`` only
    that stretch comes back, though all days enter the history. Breakpoints never leave the task
    that has found them.
    """
    names = [*(f"r{n}" for n in windows), "trigger"]
    fields = {"day": pa.date32(), "mm": pa.float64()} | {n: pa.float64() for n in names}
    begin = None if start is None else (start - date(1970, 1, 1)).days

    def work(calendar: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        wanted = np.ones(len(calendar), bool) if begin is None else (calendar >= begin) & (calendar < begin + days)
        season = _season(calendar, first, last)
        which, day = _rows(calendar[wanted], x.shape[1])
        cols, parts = {"day": day, "mm": _flat(x[wanted])}, []
        for n in windows:
            v = _totals(x, n)
            b = _breaks(np.sort(v[season & (np.arange(len(x)) >= n - 1)], axis=0), points)
            share = np.minimum(_below(b, v[wanted]) / (points - 1), 1.0)
            share[np.isnan(v[wanted])] = np.nan
            parts.append(share * np.where(np.isnan(b[:1]), np.nan, 1.0))
            cols[f"r{n}"] = _flat(v[wanted])
        yield which, cols | {"trigger": _flat(sum(parts[1:], parts[0]) / len(windows))}

    return _over_matrices(obs, fields, "day date, mm double" + "".join(f", {n} double" for n in names), work)
