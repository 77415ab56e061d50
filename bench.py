"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slopecast.plans import all_queries  # noqa: E402
from slopecast.session import local_session  # noqa: E402

HEADLINE = (
    "alert_days",
    "rain_features",
    "climatology_breaks",
    "live_trigger",
    "season_percentiles",
    "storm_stats",
    "roc_auc",
    "cv_report",
    "operating_points",
    "lead_time_profile",
    "surface_curvature",
    "flow_accumulation",
    "distance_to_flag",
    "height_above_drainage",
    "points_in_polygons",
    "touched_cells",
    "nearest_station",
    "assemble_cell_table",
    "spatial_folds",
    "training_sample",
    "landslide_hazard",
    "flood_hazard",
    "catchment_signal",
    "watch_list",
    "road_pieces",
    "road_hotspots",
    "road_network_edges",
    "bracket_asof",
    "layer_profile",
    "exact_percentiles",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    qs = all_queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(qs)
    # start the JVM's code paths before the clock does
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.time()
        qs[n].fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"{times[n]:8.2f}s {n}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
