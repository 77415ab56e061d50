"""The one-pass rain features against the window functions and against plain loops."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from slopecast.operators import rain as R
from slopecast.operators import series as Se

OBS = "station string, day date, mm double"


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(3)
    start = date(1999, 3, 20)
    rows = [(s, start + timedelta(rng.randrange(420)), rng.choice([0.0, 0.4, 1.0, 7.25, None, 33.5])) for s in ("a", "b", "c", "é") for _ in range(160)]
    rows += [("d", start + timedelta(5), 2.0), (None, start, 1.0), ("a", None, 1.0), ("a", start + timedelta(7), 3.0), ("a", start + timedelta(7), 3.0)]
    return spark.createDataFrame(rows, OBS)


def keyed(df, cols):
    return {(r.station, r.day): tuple(None if r[c] is None else round(float(r[c]), 9) for c in cols) for r in df.collect()}


@pytest.mark.parametrize("fields", [1 << 20, 1000])
def test_features_match_the_window_functions(spark, obs, monkeypatch, fields):
    monkeypatch.setattr(Se, "FIELDS", fields)  # few station-days per matrix: stations are cut apart
    known = obs.where("station is not null and day is not null")
    want = R.rain_features(R.densify(known))
    cols = ["mm", "r1", "r3", "r7", "r15", "r30", "rmax_30", "wetdays_30", "api", "storm_dur", "storm_rain", "storm_id_ratio"]
    assert keyed(Se.rain_series(obs), cols) == keyed(want, cols)


def test_history_and_live_match_the_window_functions(spark, obs):
    known = obs.where("station is not null and day is not null")
    rolled = R.trailing_sums(R.densify(known), (3, 7))
    cols = ["r3", "r7", "r3_pct", "r7_pct"]
    assert keyed(Se.season_history(obs), cols) == keyed(R.season_percentiles(rolled), cols)
    assert keyed(Se.season_trigger(obs), ["trigger"]) == keyed(R.trigger(rolled), ["trigger"])
    want = keyed(R.trigger_from_breaks(rolled, R.climatology(rolled)), ["trigger"])
    live = keyed(Se.live_series(obs), ["trigger"])
    # a breakpoint between two equal values is that value here; the built-in percentile may miss it by a rounding error
    assert live.keys() == want.keys() and all(a == b or abs(a[0] - b[0]) <= 0.0101 for a, b in ((live[k], want[k]) for k in want))
    week = keyed(Se.live_series(obs, date(1999, 7, 1), 7), ["trigger"])
    assert week == {k: v for k, v in live.items() if date(1999, 7, 1) <= k[1] < date(1999, 7, 8)} and len(week) == 35
    breaks = {r.station: (r.r3, r.r7) for r in Se.season_breaks(obs).collect()}
    for r in R.climatology(rolled).collect():
        assert breaks[r.station][r.feature == "r7"] == pytest.approx(r.breaks)


def test_short_calendars_and_empty_tables(spark):
    few = spark.createDataFrame([("a", date(2000, 1, 1), 4.0), ("b", date(2000, 1, 2), 5.0)], OBS)
    got = {(r.station, r.day.day): r for r in Se.rain_series(few).collect()}
    assert len(got) == 4 and got["a", 2].r3 is None and got["a", 2].mm == 0 and got["b", 2].storm_dur == 1 and got["a", 1].rmax_30 is None
    assert Se.season_history(few).count() == 0 and [r.r3 for r in Se.season_breaks(few).collect()] == [None, None]
    assert all(r.trigger is None for r in Se.live_series(few).collect())
    for make in (Se.rain_series, Se.season_history, Se.season_breaks, Se.live_series, Se.season_trigger):
        assert make(few.where("false")).count() == 0
    with pytest.raises(ValueError):
        Se.rain_series(few, decay=1.0)


def test_decay_is_the_recurrence(spark):
    rng = random.Random(5)
    mm = [rng.choice([0.0, 3.5, 80.0]) for _ in range(400)]
    rows = [(7, date(2001, 1, 1) + timedelta(i), v) for i, v in enumerate(mm)]
    got = [r.api for r in Se.rain_series(spark.createDataFrame(rows, "station int, day date, mm double"), windows=(1,), decay=0.97).orderBy("day").collect()]
    api = 0.0
    for i, v in enumerate(mm):
        api = v + 0.97 * api
        assert got[i] is None if i < 29 else math.isclose(got[i], api, rel_tol=1e-12)


def test_extra_columns_and_a_wet_threshold(spark, obs):
    named = obs.select("*", F.lit("x").alias("_d"), F.lit(1).alias("r3"))
    assert Se.rain_series(named, wet_mm=1000.0).agg(F.max("storm_dur")).first()[0] == 0
