"""Registered queries against their SQL on the smallest tables (``tests/oracle.py`` runs all of them)."""

import pytest

from oracle import DATA, compare, connection

QUICK = [
    "q1_pixel_mask", "q4_quality_report", "q5_quality_audit", "q11_exclusion_ledger", "q14_band_depth", "q17_stretch_byte", "a4_library_medoid",
    "s2_sam_angles", "a22_class_counts", "s4_matched_filter", "s6_ordinal_tier", "a12_rank_auc", "a18_binary_overlap", "a25_compare_rasters", "w1_average_rank",
    "j2_glt_gather", "j3_nearest_regrid", "j5_area_average", "j13_shift_join", "j16_crosswalk", "j21_granule_rank", "io2_library_parse", "io8_round_trip", "d5_endpoint_status",
]


@pytest.fixture(scope="module")
def con():
    return connection(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, f"{DATA}/sf0.001").toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180
