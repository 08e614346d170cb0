"""Plan shapes that must hold whatever the data's size."""

import pytest

import __spark_entry__ as entry
from intel_spark.catalog.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["g01_resample", "w01_price_anomalies", "w05_g05_cascades", "w08_ais_gaps", "j03_match_fuzzy", "j08_proximity_pairs", "j10_areas_containing", "j17_key_pairs", "x10_assess_transfers", "x01_vessel_risk", "j12_asof_backward", "j23_mentions", "q12_search_listings"]


@pytest.mark.parametrize("name", NAMES)
def test_no_pairing_of_everything(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["g01_resample"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1][:200]


def test_top_rows_are_cut_before_the_shuffle(spark):
    plan = entry.queries()["g08_fleet_groups"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_old_days_are_dropped_before_the_baseline_window(spark):
    plan = entry.queries()["w01_price_anomalies"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_every_query_is_registered_once_with_columns(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(queries)
    assert len(QUERIES) >= 250 and set(QUERIES) - set(ORACLES) == {"f36_sequence_ratio"}


def test_events_meet_intervals_by_day(spark):
    plan = entry.queries()["j15_events_within"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "_day" in join


def test_flagship(spark):
    assert entry.entry(spark).count() >= 0
