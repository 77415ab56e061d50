"""Breaks, percentiles against a climatology, and forecast multipliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    HAND_RANGE_M,
    LARGE_RIVER_KM2,
    LOG_AREA_HI,
    LOG_AREA_LO,
    PCT_FLOOR,
    PCT_ONSET,
)


def classify(v: Column, breaks: Sequence[float], single: bool = False) -> Column:
    """1 + number of breaks at or below ``v``; 0 where ``v`` is NULL.

    ``single`` compares in FLOAT, as stored layers do.
    """
    cast = "float" if single else "double"
    x = v.cast(cast)
    n = F.lit(1)
    for b in breaks:
        n = n + (x >= F.lit(b).cast(cast)).cast("int")
    return F.when(v.isNull(), F.lit(0)).otherwise(n)


def classify_positive(v: Column, breaks: Sequence[float], single: bool = False) -> Column:
    """Like :func:`classify`, but zero and below is class 0 (not flood-prone)."""
    return F.when(v > 0, classify(v, breaks, single)).otherwise(F.lit(0))


def break_pct(v: Column, breaks: Column) -> Column:
    """Share of 101 sorted climatology breakpoints strictly below ``v``, at most 1.

    Seven halving steps find the count; scanning all 101 would cost 14 times as much.
    """
    steps = F.array(*[F.lit(2**k) for k in range(6, -1, -1)])
    below = F.aggregate(
        steps, F.lit(0),
        lambda lo, s: F.when((lo + s <= F.size(breaks)) & (F.get(breaks, lo + s - 1) < v), lo + s).otherwise(lo),
    )
    return F.when(v.isNotNull(), F.least(below / F.lit(100.0), F.lit(1.0)))


def trigger_response(pct: Column) -> Column:
    raw = (pct - F.lit(PCT_ONSET)) / F.lit(1.0 - PCT_ONSET)
    return F.when(pct.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(PCT_FLOOR), raw)))


def river_class(area_km2: Column) -> Column:
    return F.when(area_km2 >= F.lit(LARGE_RIVER_KM2), "large").otherwise("watch")


def floodprone_index(hand: Column, acc: Column) -> Column:
    low = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - hand / F.lit(HAND_RANGE_M)))
    size = (F.log10(F.greatest(acc.cast("double"), F.lit(1.0))) - F.lit(LOG_AREA_LO)) / F.lit(
        LOG_AREA_HI - LOG_AREA_LO
    )
    return low * F.least(F.lit(1.0), F.greatest(F.lit(0.0), size))


def lead_label(issued: Column, day: Column) -> tuple[Column, Column]:
    """Days ahead and the confidence word that goes with them."""
    lead = F.datediff(day, issued)
    return lead, F.when(lead <= 3, "higher").otherwise("lower")


def alpha_mask(alpha: Column) -> Column:
    return (alpha > 0).cast("int")


def in_season(day: Column, first: int = 5, last: int = 10) -> Column:
    return F.month(day).between(first, last)


def verdict(cond: Column) -> Column:
    return F.when(cond, "PASS").otherwise("FAIL")
