"""Registered queries against their SQL on the smallest tables (TIDEMARK_ALL=1 runs every one)."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle_check import compare, connect
from tidemark import plans

SF = "/root/testdata/sf0.001"
FAST = """climatology_pairs classify_state order_stat_baseline zone_statistics asof_bracket successive_change per_sensor_zscore trend hue_angle nechad
significance_mask point_in_polygon erode dilate connected_components distance_transform datatake_group mosaic_first_valid dn_to_reflectance asset_assign_aoi
srf_matrix spectral_resample continuum_removal fingerprint matchup_build nearest_asset_join exposure_assess drift_bounds severity priority_rules replay_status
payload_validate audit_chain_verify production_model group_split auroc average_precision ece grouped_bootstrap dataset_hash incremental_screen_stream
fit_logistic fit_ridge_log10 leave_one_group_out model_zoo_linear rx_pooled pca_reduce recommend incident_detail sinks alert_new_stream""".split()
NAMES = sorted(oracle_sql()) if os.environ.get("TIDEMARK_ALL") else FAST


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, why, _ = compare(spark, con, queries()[name], oracle_sql()[name], SF)
    assert ok, why


def test_every_query_is_callable_and_most_have_sql():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    own = plans.load()
    assert set(own.ORACLES) <= set(own.QUERIES) <= set(q) and set(own.QUERIES) - set(own.ORACLES) == {"model_zoo_cv"}
