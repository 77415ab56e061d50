"""Registered queries at the smallest scale, against their SQL twins.

By default a cross-section of every family runs (a few minutes); TEST_ALL=1 runs all.
"""

import os

import pytest
from compare import compare, duck

from slopecast.plans import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()
CROSS_SECTION = (
    "alert_days rain_features antecedent_index climatology_breaks live_trigger roc_auc average_precision precision_at_top "
    "operating_points kruskal_wallis class_agreement spatial_folds sample_negatives matched_controls background_draw "
    "cell_codes bilinear_sample block_mode assemble_cell_table classify_breaks quantised_layers surface_curvature "
    "flow_accumulation distance_to_flag points_in_polygons touched_cells nearest_station corridor_cells landslide_hazard "
    "catchment_signal flood_hazard watch_list lead_time_profile road_pieces road_hotspots network_components "
    "exact_percentiles layer_histograms synthetic_rows membership_hash bracket_asof place_labels parsed_coordinates "
    "feature_collection daily_files climate_index_file attached_provenance stream_daily_totals stream_wet_spells stream_carried_index"
).split()
CHOSEN = sorted(QUERIES) if os.environ.get("TEST_ALL") else CROSS_SECTION


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    res = compare(spark, con, QUERIES[name], SF)
    assert not res.startswith("FAIL"), res


def test_names_say_what_they_do():
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op") and n[2:3].isdigit()]
