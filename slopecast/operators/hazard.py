"""Static ground x daily rain: landslide and flood outlooks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALERT_LEVEL, FLOOD_HAZARD_BREAKS, LANDSLIDE_BREAKS
from ..functions.classify import classify, classify_positive, river_class, trigger_response
from ..session import reused
from .catchment import upstream_mean
from .ranking import percentiles


def _days(df: DataFrame) -> Column:
    """The days of an outlook as one small array."""
    return df.agg(F.sort_array(F.collect_set("day")).alias("days")).scalar()


def landslide_hazard(cells: DataFrame, trig: DataFrame) -> DataFrame:
    """Susceptibility x trigger per cell and day; NULL, class 0, when either is.

    ``cells``: (cell_id, rain_id, susceptibility). Rain stays on its own coarse ids: the
    join multiplies cells by the requested days only. A cell whose rain id has no row comes
    back for every day with a NULL trigger.
    """
    t = trig.select(F.col("station").alias("rain_id"), "day", "trigger")
    dry = cells.join(t.select("rain_id").distinct(), "rain_id", "left_anti").withColumn("day", F.explode(_days(t)))
    j = cells.join(t, "rain_id").unionByName(dry.withColumn("trigger", F.lit(None).cast("double")))
    h = F.col("susceptibility") * F.col("trigger")
    return j.withColumn("hazard", h).withColumn("cls", classify(F.col("hazard"), LANDSLIDE_BREAKS))


def catchment_signal(basins: DataFrame, rain: DataFrame) -> DataFrame:
    """Upstream mean rain and anomaly per basin and day, with the upstream area; ``rain``: (station, day, mm, trigger)."""
    daily = rain.select(F.col("station").alias("rain_pt"), "day", "mm", "trigger")
    values = basins.select("basin", "rain_pt").join(daily, "rain_pt").select(
        "basin", "day", F.col("mm").alias("up_mm"), F.col("trigger").alias("up_pct")
    )
    return upstream_mean(basins, values, ["up_mm", "up_pct"], ["day"])


def flood_hazard(cells: DataFrame, signal: DataFrame) -> DataFrame:
    """Index/254 x response of the cell's basin; 0, class 0, where there is no index or basin.

    ``cells``: (cell_id, idx 0..254, basin). One row per cell and day. Only flood-prone cells
    meet the signal; the rest get their zero per day without a join on the basin. A flood-prone
    cell whose basin has no signal comes back for every day with a NULL hazard, class 0.
    """
    s = signal.select("basin", "day", trigger_response(F.col("up_pct")).alias("response"))
    prone = F.coalesce((F.col("idx") > 0) & F.col("basin").isNotNull(), F.lit(False))
    live, days = cells.where(prone), _days(signal)
    hz = F.col("idx") / F.lit(254.0) * F.col("response")
    wet = live.join(s, "basin").select("cell_id", "basin", "day", hz.alias("hazard"))
    unknown = live.join(s.select("basin").distinct(), "basin", "left_anti").withColumn("hazard", F.lit(None).cast("double"))
    rest = unknown.select("cell_id", "basin", "hazard").unionByName(cells.where(~prone).select("cell_id", "basin", F.lit(0.0).alias("hazard")))
    out = wet.unionByName(rest.select("cell_id", "basin", F.explode(days).alias("day"), "hazard"))
    return out.withColumn("cls", classify_positive(F.col("hazard"), FLOOD_HAZARD_BREAKS))


def worst_day(outlook: DataFrame, key: str, value: str = "hazard") -> DataFrame:
    """Largest value per key; the earliest day wins a tie."""
    return outlook.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.min_by("day", F.struct((-F.col(value)).alias("v"), "day")).alias("worst_day"), F.max(value).alias("worst")
    )


def location_outlook(places: DataFrame, snapped: DataFrame, hazard: DataFrame, pid: str) -> DataFrame:
    """Seven days of hazard at each place's snapped cell."""
    at = places.select(pid).join(snapped, pid).where(F.col("snap_row").isNotNull())
    return at.join(hazard, (at.snap_row == hazard.row) & (at.snap_col == hazard.col)).select(
        pid, "snap_dist", "day", "hazard", "cls"
    )


def day_summary(trig: DataFrame, high: DataFrame, level: float = ALERT_LEVEL) -> DataFrame:
    """Points at alert, exact median trigger, the wettest point and the high share, per day."""
    med = percentiles(trig, "trigger", [0.5], ["day"]).select("day", F.col("p0").alias("median_trigger"))
    base = trig.groupBy("day").agg(
        F.count_if(F.col("trigger") >= level).alias("points_alert"),
        F.min_by("station", F.struct((-F.col("trigger")).alias("t"), "station")).alias("top_point"),
    )
    return base.join(med, "day", "left").join(high, "day", "left")


def watch_list(signal: DataFrame, floodplain: DataFrame, k: int = 40) -> DataFrame:
    """The k basins with flood-prone ground whose upstream rain is most unusual."""
    cand = signal.join(floodplain.select("basin").distinct(), "basin", "left_semi")
    return cand.orderBy(F.desc("up_pct"), "basin").limit(k).withColumn("tier", river_class(F.col("up_area")))


def lead_time_profile(trig: DataFrame, events: DataFrame, leads: Sequence[int] = tuple(range(-5, 3)), level: float = ALERT_LEVEL) -> DataFrame:
    """Median trigger and share at alert by day relative to the event."""
    trig = reused(trig.select("station", "day", "trigger"))
    offs = events.select("station", "day", F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead"))
    at = reused(offs.select("station", "lead", F.date_add("day", F.col("lead")).alias("day")).join(trig, ["station", "day"]).select("lead", "trigger"))
    med = percentiles(at, "trigger", [0.5], ["lead"]).select("lead", F.col("p0").alias("median_trigger"))
    base = at.groupBy("lead").agg(
        F.avg((F.col("trigger") >= level).cast("double")).alias("share_alert"), F.count(F.lit(1)).alias("n")
    )
    ordinary = percentiles(trig, "trigger", [0.5]).select("p0").scalar()
    return base.join(med, "lead", "left").withColumn("ordinary_median", ordinary)


def unit_rollup(cells: DataFrame, unit: str, level: Column, near: Column) -> DataFrame:
    """Share of each unit's cells above alert, and alert cells near a settlement."""
    return cells.groupBy(unit).agg(
        F.avg(level.cast("double")).alias("alert_share"), F.count_if(level & near).alias("alert_near"), F.count(F.lit(1)).alias("cells")
    )


def gauge_labels(readings: DataFrame, p: float) -> DataFrame:
    """Days on which a station's peak reaches its own high percentile."""
    daily = readings.groupBy("station", "day").agg(F.max("mm").alias("peak"))
    cut = daily.groupBy("station").agg(F.percentile("peak", p).alias("warning"))
    return daily.join(cut, "station").withColumn("flood_day", (F.col("peak") >= F.col("warning")).cast("int"))
