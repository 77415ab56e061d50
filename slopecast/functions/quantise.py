"""Compact integer encodings used when layers are published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8_unit(v: Column) -> Column:
    """[0, 1] to 0..254, 255 = not assessed."""
    q = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * F.lit(254.0))
    return F.coalesce(q.cast("short"), F.lit(255).cast("short"))


def u16_metres(v: Column) -> Column:
    """Whole metres clipped to 0..65534, 65535 = no data."""
    q = F.bround(F.least(F.lit(65534.0), F.greatest(F.lit(0.0), v)))
    return F.coalesce(q.cast("int"), F.lit(65535))


def u8_ranged(v: Column, lo: float, hi: float) -> Column:
    """[lo, hi] to 1..255, 0 reserved for no data."""
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.lit(lo)) / F.lit(hi - lo)))
    return F.coalesce((F.lit(1) + F.bround(unit * F.lit(254.0))).cast("short"), F.lit(0).cast("short"))


def u8_sqrt(v: Column, top: float) -> Column:
    return u8_ranged(F.sqrt(F.greatest(v, F.lit(0.0))), 0.0, top**0.5)


def u8_log(v: Column, top_log10: float) -> Column:
    return u8_ranged(F.log10(F.greatest(v, F.lit(0.0)) + F.lit(1.0)), 0.0, top_log10)


# --- fixed values: unit conversions applied to delivered layers ---
def per_mille_to_percent(v: Column) -> Column:
    return v / F.lit(10.0)


def kelvin_to_celsius(v: Column) -> Column:
    return v - F.lit(273.15)


def cells_to_km2(n: Column, cell_m: float = 100.0) -> Column:
    return n * F.lit(cell_m * cell_m / 1e6)


def metres_to_km(v: Column) -> Column:
    return v / F.lit(1000.0)
