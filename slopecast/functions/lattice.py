"""Lattice algebra and flat-earth geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    KM_PER_DEG,
    KM_PER_DEG_LAT,
    KM_PER_DEG_LON,
    LON_SHRINK,
    GridSpec,
    WebGrid,
)


def cell_id(row: Column, col: Column, grid: GridSpec = GridSpec()) -> Column:
    return row.cast("long") * F.lit(grid.stride) + col.cast("long")


def decode_row(cid: Column, grid: GridSpec = GridSpec()) -> Column:
    return F.floor(cid / F.lit(grid.stride)).cast("int")


def decode_col(cid: Column, grid: GridSpec = GridSpec()) -> Column:
    return F.pmod(cid, F.lit(grid.stride)).cast("int")


def centre_x(col: Column, grid: GridSpec = GridSpec()) -> Column:
    return F.lit(grid.origin_x) + (col + F.lit(0.5)) * F.lit(grid.cell)


def centre_y(row: Column, grid: GridSpec = GridSpec()) -> Column:
    return F.lit(grid.top_y) - (row + F.lit(0.5)) * F.lit(grid.cell)


def row_of(y: Column, grid: GridSpec = GridSpec()) -> Column:
    """Unclamped: callers filter with :func:`in_grid`."""
    return F.floor((F.lit(grid.top_y) - y) / F.lit(grid.cell)).cast("int")


def col_of(x: Column, grid: GridSpec = GridSpec()) -> Column:
    return F.floor((x - F.lit(grid.origin_x)) / F.lit(grid.cell)).cast("int")


def in_grid(row: Column, col: Column, grid: GridSpec = GridSpec()) -> Column:
    return row.between(0, grid.nrows - 1) & col.between(0, grid.ncols - 1)


def block_id(row: Column, col: Column, size: int = 500, grid: GridSpec = GridSpec()) -> Column:
    return F.floor(row / F.lit(size)) * F.lit(grid.stride) + F.floor(col / F.lit(size))


def web_inside(lat: Column, lon: Column, g: WebGrid) -> Column:
    return lat.between(g.south, g.north) & lon.between(g.west, g.east)


def web_pixel(lat: Column, lon: Column, g: WebGrid) -> tuple[Column, Column]:
    """Inclusive box test, truncation, clamp at the far edge; NULL outside."""
    inside = web_inside(lat, lon, g)
    r = ((F.lit(g.north) - lat) / F.lit(g.north - g.south) * F.lit(g.height)).cast("int")
    c = ((lon - F.lit(g.west)) / F.lit(g.east - g.west) * F.lit(g.width)).cast("int")
    return (
        F.when(inside, F.least(r, F.lit(g.height - 1))),
        F.when(inside, F.least(c, F.lit(g.width - 1))),
    )


def web_pixel_open(lat: Column, lon: Column, g: WebGrid) -> tuple[Column, Column, Column]:
    """Truncated pixel plus an in-bounds flag; out-of-bounds points are not clamped."""
    r = ((F.lit(g.north) - lat) / F.lit(g.north - g.south) * F.lit(g.height)).cast("int")
    c = ((lon - F.lit(g.west)) / F.lit(g.east - g.west) * F.lit(g.width)).cast("int")
    ok = r.between(0, g.height - 1) & c.between(0, g.width - 1)
    return r, c, ok


def web_centre_lat(row: Column, g: WebGrid) -> Column:
    return F.lit(g.north) - (row + F.lit(0.5)) * F.lit((g.north - g.south) / g.height)


def web_centre_lon(col: Column, g: WebGrid) -> Column:
    return F.lit(g.west) + (col + F.lit(0.5)) * F.lit((g.east - g.west) / g.width)


def web_cell_width_km(lat: Column, g: WebGrid) -> Column:
    return F.lit((g.east - g.west) / g.width * KM_PER_DEG) * F.cos(F.radians(lat))


def km_local(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres with one fixed scale per axis."""
    dy = (lat1 - lat2) * F.lit(KM_PER_DEG_LAT)
    dx = (lon1 - lon2) * F.lit(KM_PER_DEG_LON)
    return F.sqrt(dy * dy + dx * dx)


def km_shrunk(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres with the longitude axis shrunk by a constant."""
    dy = lat1 - lat2
    dx = (lon1 - lon2) * F.lit(LON_SHRINK)
    return F.sqrt(dy * dy + dx * dx) * F.lit(KM_PER_DEG)


def degrees_cos(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees with the longitude axis shrunk by the cosine of the first latitude."""
    dy = lat1 - lat2
    dx = (lon1 - lon2) * F.cos(F.radians(lat1))
    return F.sqrt(dy * dy + dx * dx)


def in_area(lat: Column, lon: Column, g: WebGrid, pad: float = 0.0) -> Column:
    return lat.between(g.south - pad, g.north + pad) & lon.between(g.west - pad, g.east + pad)


EARTH_RADIUS_M = 6_378_137.0


def lon_from_mercator(x: Column) -> Column:
    return F.degrees(x / F.lit(EARTH_RADIUS_M))


def lat_from_mercator(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(EARTH_RADIUS_M))) - F.lit(3.141592653589793 / 2))


def overlap_percent(w, s, e, n, aoi: tuple[float, float, float, float]) -> Column:
    """Share of an area of interest (west, south, east, north) that a box covers."""
    aw, as_, ae, an = aoi
    dx = F.greatest(F.lit(0.0), F.least(e, F.lit(ae)) - F.greatest(w, F.lit(aw)))
    dy = F.greatest(F.lit(0.0), F.least(n, F.lit(an)) - F.greatest(s, F.lit(as_)))
    return F.lit(100.0) * dx * dy / F.lit((ae - aw) * (an - as_))


def tile_name(lat: Column, lon: Column, step: int) -> Column:
    """South-west corner name such as N27E093."""
    la = (F.floor(lat / F.lit(step)) * F.lit(step)).cast("int")
    lo = (F.floor(lon / F.lit(step)) * F.lit(step)).cast("int")

    def padded(n: Column, width: int) -> Column:
        digits = F.abs(n).cast("string")  # lpad alone would cut longer numbers
        return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), "0")

    return F.concat(
        F.when(la < 0, F.lit("S")).otherwise(F.lit("N")),
        padded(la, 2),
        F.when(lo < 0, F.lit("W")).otherwise(F.lit("E")),
        padded(lo, 3),
    )
