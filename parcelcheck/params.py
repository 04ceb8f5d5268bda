"""Limits of the checks and the description of a layer."""

from __future__ import annotations

from dataclasses import dataclass

# Limits every check compares against.
MIN_SUBPLOT_AREA = 450.0
MAX_SUBPLOT_AREA = 750.0
MIN_PLOT_AREA = 2000.0
MAX_PLOT_AREA = 20000.0
MAX_VERTICES = 4
LENGTH_WIDTH_LIMIT = 2.0
PROTRUDING_LIMIT = 1.55
SUBPLOT_RADIUS_M = 40.0
PLOT_RADIUS_M = 200.0
OVERLAP_LIMIT_V1 = 0.1
OVERLAP_LIMIT_V2 = 0.5
SUBPLOT_BUFFER_M = -5.0
PLOT_BUFFER_M = 0.0
GPS_ACCURACY_M = 10.0
RAW_GPS_ACCURACY_M = 1000.0
TRACE_CELL_LIMIT = 32767
COUNTRY_BUFFER_M = 10000.0
CLOUD_LIMIT_PCT = 20
NDVI_SCENES = 6
NDVI_LOOKBACK_DAYS = 365
OUTLIER_FACTOR = 4
TALL_TREE_M = 25
MAX_STEMS = 20
MAX_CIRCUMFERENCE_CM = 90


@dataclass(frozen=True)
class LayerSpec:
    """One layer (plots or subplots) and the rule generation it is checked with."""

    id_column: str
    min_area: float
    max_area: float
    radius_m: float
    min_overlap: float = OVERLAP_LIMIT_V1
    overlap_buffer_m: float = SUBPLOT_BUFFER_M
    generation: int = 1
    length_width: bool = True
    country: str | None = "IND"
    max_vertices: int = MAX_VERTICES
    length_width_limit: float = LENGTH_WIDTH_LIMIT
    protruding_limit: float = PROTRUDING_LIMIT

    @property
    def geodesic(self) -> bool:
        return self.generation == 2


SUBPLOTS_V1 = LayerSpec("subplot_id", MIN_SUBPLOT_AREA, MAX_SUBPLOT_AREA, SUBPLOT_RADIUS_M)
PLOTS_V1 = LayerSpec(
    "plot_id",
    MIN_PLOT_AREA,
    MAX_PLOT_AREA,
    PLOT_RADIUS_M,
    overlap_buffer_m=PLOT_BUFFER_M,
    length_width=False,
)
SUBPLOTS_V2 = LayerSpec(
    "subplot_id",
    MIN_SUBPLOT_AREA,
    MAX_SUBPLOT_AREA,
    SUBPLOT_RADIUS_M,
    min_overlap=OVERLAP_LIMIT_V2,
    generation=2,
    country=None,
)
