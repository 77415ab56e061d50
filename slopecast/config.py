"""Region settings and the fixed cut-offs that published results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: breaks, thresholds and constants that results depend on ---
LANDSLIDE_BREAKS = (0.02, 0.06, 0.15, 0.30)
SUSCEPTIBILITY_BREAKS = (0.05, 0.15, 0.35, 0.60)
TRIGGER_BREAKS = (0.50, 0.75, 0.90, 0.97)
FLOOD_HAZARD_BREAKS = (0.04, 0.10, 0.20, 0.33)
FLOOD_INDEX_BREAKS = (0.08, 0.20, 0.40, 0.65)
CLASS_PERCENTILES = (0.50, 0.75, 0.90, 0.97)
CLASS_NAMES = ("Very Low", "Low", "Moderate", "High", "Very High")

RAIN_WINDOWS = (1, 3, 7, 15, 30)
WET_DAY_MM = 1.0
API_DECAY = 0.92
# published intensity-duration curves I = a * D^-b (mm/h, D in hours)
ID_CURVES = {"caine1980": (14.82, 0.39), "guzzetti2008": (2.20, 0.44)}
SEASON_MONTHS = (5, 10)
ALERT_LEVEL = 0.90

KM_PER_DEG_LAT = 110.6
KM_PER_DEG_LON = 98.9
LON_SHRINK = 0.89
KM_PER_DEG = 111.0

HAND_RANGE_M = 25.0
LOG_AREA_LO, LOG_AREA_HI = 4.0, 6.0
CHANNEL_CELLS = 10_000
MIN_SLOPE_DEG = 0.1
DOMAIN_SLOPE_DEG = 10.0
EXCLUDED_LANDCOVER = (70, 80, 100)
PCT_ONSET, PCT_FLOOR = 0.35, 0.02
LARGE_RIVER_KM2 = 2_000.0
SNAP_M = 120.0
METRES_PER_DEG = 111_000.0
SAME_PLACE_KM = 12.0
LABEL_BUFFER_M = 500.0
NEGATIVES_PER_POSITIVE = 5
N_FOLDS = 5
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class GridSpec:
    """A metric lattice: row 0 is the top row, cell ids are row * stride + col."""

    origin_x: float = 350_000.0
    top_y: float = 2_950_000.0
    cell: float = 100.0
    nrows: int = 3_200
    ncols: int = 5_900
    stride: int = 100_000


@dataclass(frozen=True)
class WebGrid:
    """A latitude/longitude display lattice with an inclusive bounding box."""

    west: float
    south: float
    east: float
    north: float
    width: int
    height: int


# The lattice the bundled queries use: one degree of the fixture = 100 cells.
FIXTURE_GRID = GridSpec(origin_x=0.0, top_y=0.0, cell=100.0)
