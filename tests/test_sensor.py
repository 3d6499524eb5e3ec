"""Sensor job operators on small inline rows: nulls, NaN, infinities, -0.0,
unmatched keys, fan-out, ties, null timestamps and null locations."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import sensor as ops
from quarry.plans.sensor import sensor_pipeline
from quarry.sources.sensor import LOOKUP_SCHEMA, METADATA_SCHEMA, SENSOR_SCHEMA


# literal values of log(|x| + 1) * sin(x)
TRANSFORMED = {1.5: 0.9139954113162296, -2.0: -0.9989653271649853, 0.0: 0.0, 3.0: 0.19563387141458743, 4.0: -1.2180266281733099}


READINGS = [
    ("s1", 1.5, 100), ("s1", -2.0, 100), ("s1", 0.0, 50), ("s2", -0.0, None), ("s2", float("nan"), 10),
    ("s3", float("inf"), 5), ("s3", float("-inf"), 6), ("s4", None, 7), ("s9", 3.0, 8), ("s5", 4.0, 9),
]
META = [("s1", "north", "A"), ("s2", "north", "B"), ("s3", None, "A"), ("s4", "south", "A"),
        ("s5", "south", None), ("s1", "east", "A")]  # s1 twice: fan-out; s9 absent: unmatched
LOOKUP = [("A", 2.0), ("C", 5.0)]


@pytest.fixture
def frames(spark):
    return (spark.createDataFrame(READINGS, SENSOR_SCHEMA), spark.createDataFrame(META, METADATA_SCHEMA),
            spark.createDataFrame(LOOKUP, LOOKUP_SCHEMA))


def test_transform_of_literals(spark, frames):
    r, _, _ = frames
    for row in r.withColumn("transformed_reading", ops.transformed_reading_expr("reading")).collect():
        if row.reading is None:
            assert row.transformed_reading is None
        elif math.isfinite(row.reading):
            assert row.transformed_reading == pytest.approx(TRANSFORMED[row.reading], rel=1e-9)
        else:
            assert math.isnan(row.transformed_reading)


def test_filter_keeps_nan_drops_null(spark, frames):
    r, _, _ = frames
    kept = ops.transform_readings(r)
    assert kept.count() == len(READINGS) - 1  # only the null reading goes
    nan_rows = kept.filter(F.isnan("transformed_reading")).count()
    assert nan_rows == 3  # NaN, +inf and -inf all give NaN


def test_filter_pushed_into_scan(spark, tmp_dir, frames):
    r, _, _ = frames
    r.write.parquet(f"{tmp_dir}/r")
    from quarry.sources.sensor import read_sensor_data
    plan = ops.transform_readings(read_sensor_data(spark, f"{tmp_dir}/r"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(reading)]" in plan


def test_joins_fanout_unmatched_and_column_order(spark, frames):
    r, m, l = frames
    j = ops.calibrated_readings(ops.transform_readings(r), m, l)
    rows = j.collect()
    # s1 has 3 readings and 2 metadata rows -> 6; the others 1 each (s4 null reading dropped)
    assert len(rows) == 3 * 2 + 2 + 2 + 1 + 1
    assert j.columns[:2] == ["device_type", "sensor_id"]
    s9 = [x for x in rows if x.sensor_id == "s9"][0]
    assert s9.location is None and s9.device_type is None and s9.calibrated_reading is None
    s5 = [x for x in rows if x.sensor_id == "s5"][0]  # null device type never matches
    assert s5.calibration_factor is None
    s2 = [x for x in rows if x.sensor_id == "s2"]  # device B is not in the lookup
    assert all(x.calibration_factor is None for x in s2)
    s1 = [x for x in rows if x.sensor_id == "s1" and x.reading == 1.5][0]
    assert s1.calibrated_reading == pytest.approx(TRANSFORMED[1.5] * 2.0)


def test_rank_ties_nulls_and_null_location(spark, frames):
    r, m, l = frames
    for strategy in ("window", "auto"):
        j = ops.rank_readings(ops.calibrated_readings(ops.transform_readings(r), m, l), strategy=strategy)
        got = [(x.location, x.timestamp, x.reading_rank) for x in j.collect()]
        north = [(t, k) for loc, t, k in got if loc == "north"]
        # s2 -0.0 has a null timestamp -> first; s1 readings at 50, 100, 100 tie -> 2, 3, 3; s2 NaN at 10
        assert sorted(north, key=lambda v: (v[0] is not None, v[0] or 0)) == [(None, 1), (10, 2), (50, 3), (100, 4), (100, 4)]
        nulls = [(t, k) for loc, t, k in got if loc is None]
        assert sorted(nulls) == [(5, 1), (6, 2), (8, 3)]  # s3 twice and unmatched s9 share the null group


def test_aggregate_null_group_and_nan(spark, frames):
    r, m, l = frames
    agg = {x.location: x for x in ops.location_summary(
        ops.calibrated_readings(ops.transform_readings(r), m, l)).collect()}
    assert set(agg) == {"north", "south", "east", None}
    assert math.isnan(agg[None].avg_calibrated) and math.isnan(agg[None].max_calibrated)  # inf readings
    assert agg["south"].avg_calibrated is None  # s5 has no calibration, s4's reading was null


def test_enrich_constant_time(spark, frames):
    r, m, l = frames
    det, _ = sensor_pipeline(r, m, l, as_of=dt.datetime(2024, 5, 6, 7, 8, 9))
    vals = {(x.processing_time, x.processing_date) for x in det.collect()}
    assert vals == {("2024-05-06T07:08:09", "2024-05-06")}
    assert det.columns == ops.DETAILED_COLUMNS


def test_aggregate_plan_has_no_window(spark, frames):
    r, m, l = frames
    _, agg = sensor_pipeline(r, m, l)
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInPandas" not in plan
    assert "HashAggregate" in plan  # partial + final


def test_nan_reaches_the_aggregate_of_a_run(spark, tmp_dir):
    """NaN, null and big values are the same in the written table, whatever the rank."""
    from quarry.plans.sensor import SensorJobConfig, run_sensor_job
    inputs = (spark.createDataFrame([("s1", float("inf"), 1), ("s1", 2.0, 1), ("s1", 3.0, None)], SENSOR_SCHEMA),
              spark.createDataFrame([("s1", "north", "A")], METADATA_SCHEMA), spark.createDataFrame([("A", 2.0)], LOOKUP_SCHEMA))
    cfg = SensorJobConfig("", "", "", f"{tmp_dir}/d", f"{tmp_dir}/a", "quarry_t", "nan_detailed", "nan_aggregated")
    run = run_sensor_job(spark, cfg, inputs=inputs)
    assert math.isnan(run.aggregated.first().avg_calibrated)
    assert sorted((str(r.reading), r.reading_rank) for r in run.detailed.collect()) == [("2.0", 2), ("3.0", 1), ("inf", 2)]
