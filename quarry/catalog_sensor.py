"""Registered sensor-job queries and their DuckDB twins.

Every query reads the shared tables through ``quarry.sources.fixtures`` so its
work grows with the scale factor.  Doubles that pass through ``sin``/``log``
are rounded to 6 places on both sides (JVM and libm differ in the last digit).
"""

from __future__ import annotations

import datetime as _dt

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.numeric import round_double
from quarry.operators import sensor as ops
from quarry.operators.rank import rank_within
from quarry.operators.sinks import clone_table, write_table
from quarry.operators.report import metrics_json
from quarry.plans.sensor import SensorJobConfig, run_sensor_job, sensor_pipeline, write_report
from quarry.session import scratch_path
from quarry.sources import fixtures as fx

AS_OF = _dt.datetime(2024, 2, 1, 6, 30, 0)

R6 = ["transformed_reading", "calibrated_reading", "avg_calibrated", "max_calibrated"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[round_double(c).alias(c) if c in R6 else F.col(c) for c in df.columns])


def _valid(spark, sf):
    return ops.transform_readings(fx.sensor_readings(spark, sf))


def _joined(spark, sf):
    r, m, l = fx.sensor_inputs(spark, sf)
    return ops.calibrated_readings(ops.transform_readings(r), m, l)


def q_sensor_scan(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sensor_readings(spark, sf)


def q_metadata_scan(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sensor_metadata(spark, sf)


def q_transform_reading(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.sensor_readings(spark, sf)
    return _rounded(r.withColumn("transformed_reading", ops.transformed_reading_expr("reading")))


def q_valid_readings(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_valid(spark, sf))


def q_join_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_valid(spark, sf).join(fx.sensor_metadata(spark, sf), on="sensor_id", how="left"))


def q_join_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_joined(spark, sf).drop("calibrated_reading"))


def q_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_joined(spark, sf))


def q_reading_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ops.rank_readings(_joined(spark, sf)))


def q_reading_rank_window(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ops.rank_readings(_joined(spark, sf), strategy="window"))


def q_reading_rank_ties(spark: SparkSession, sf: str) -> DataFrame:
    j = _joined(spark, sf).withColumn("hour", (F.col("timestamp") / 3600).cast("int"))
    return _rounded(rank_within(j, "location", "hour", "hour_rank"))


def q_sensor_aggregated(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ops.location_summary(_joined(spark, sf)))


def q_sensor_detailed(spark: SparkSession, sf: str) -> DataFrame:
    r, m, l = fx.sensor_inputs(spark, sf)
    det, _ = sensor_pipeline(r, m, l, as_of=AS_OF)
    return _rounded(det)


def _run(spark: SparkSession, sf: str):
    """The whole job: three Parquet inputs read with declared schemas
    (S1-S3; here written first from the shared tables), two table sinks and the report."""
    base = scratch_path(spark, "sensor-run")
    cfg = SensorJobConfig(
        sensor_data_path=f"{base}/in/sensor", metadata_path=f"{base}/in/metadata", lookup_path=f"{base}/in/lookup",
        detailed_output_path=f"{base}/detailed", aggregated_output_path=f"{base}/aggregated",
        database="quarry_iot", detailed_table=f"detailed_{base[-12:]}", aggregated_table=f"aggregated_{base[-12:]}",
    )
    r, m, l = fx.sensor_inputs(spark, sf)
    r.write.parquet(cfg.sensor_data_path)
    m.write.parquet(cfg.metadata_path)
    l.write.parquet(cfg.lookup_path)
    return run_sensor_job(spark, cfg, as_of=AS_OF), cfg


def q_lookup_scan(spark: SparkSession, sf: str) -> DataFrame:
    return fx.calibration_lookup(spark, sf)


def q_detailed_readback(spark: SparkSession, sf: str) -> DataFrame:
    """The detailed table of a whole run, read by its name."""
    _, cfg = _run(spark, sf)
    return _rounded(spark.table(f"{cfg.database}.{cfg.detailed_table}"))


def q_metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    """The run's metrics as JSON, read back from the JSON text."""
    text = metrics_json(_run(spark, sf)[0].report)
    return text.select(F.explode(F.from_json("metrics", "map<string,bigint>")).alias("metric", "value"))


def q_report_table(spark: SparkSession, sf: str) -> DataFrame:
    """Report table after a run and a run whose input is missing: the second leaves an error row."""
    run, cfg = _run(spark, sf)
    name, path = f"report_{cfg.detailed_table}", f"{cfg.detailed_output_path}-report"
    write_report(run.report, cfg.database, name, path)
    try:
        run_sensor_job(spark, replace(cfg, sensor_data_path=f"{cfg.sensor_data_path}-missing"), as_of=AS_OF)
    except AnalysisException as failed:
        write_report(failed.run_report, cfg.database, name, path)
    return spark.table(f"{cfg.database}.{name}").select("stage", "metric", "value", F.col("error").isNotNull().alias("failed"))


def q_table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    run, _ = _run(spark, sf)
    return _rounded(run.aggregated)


def q_run_report(spark: SparkSession, sf: str) -> DataFrame:
    run, _ = _run(spark, sf)
    return run.report.select("stage", "metric", "value")


def q_stream_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Readings derived from ``events`` are written as files, then streamed through the job's stateless part."""
    from quarry.streaming.sensor_stream import start_sensor_stream
    base = scratch_path(spark, "stream")
    r, m, l = fx.sensor_inputs(spark, sf)
    r.write.parquet(f"{base}/in")
    q = start_sensor_stream(spark, f"{base}/in", m, l, f"{base}/out", f"{base}/progress")
    q.awaitTermination()
    return _rounded(spark.read.parquet(f"{base}/out"))


def q_table_clone(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "clone")
    tag = base[-12:]
    src = write_table(fx.sensor_metadata(spark, sf), "quarry_bi", f"metadata_{tag}", f"{base}/src")
    clone_table(spark, src, f"quarry_bi.metadata_copy_{tag}", path=f"{base}/copy")
    status = clone_table(spark, src, f"quarry_bi.metadata_copy_{tag}")  # second call: left alone
    assert status.first()["status"] == "exists"
    return spark.table(f"quarry_bi.metadata_copy_{tag}")


QUERIES = {
    "sensor_scan": q_sensor_scan,
    "metadata_scan": q_metadata_scan,
    "transform_reading": q_transform_reading,
    "valid_readings": q_valid_readings,
    "join_metadata": q_join_metadata,
    "join_lookup": q_join_lookup,
    "calibrated": q_calibrated,
    "reading_rank": q_reading_rank,
    "reading_rank_window": q_reading_rank_window,
    "reading_rank_ties": q_reading_rank_ties,
    "sensor_aggregated": q_sensor_aggregated,
    "sensor_detailed": q_sensor_detailed,
    "table_roundtrip": q_table_roundtrip,
    "run_report": q_run_report,
    "table_clone": q_table_clone,
    "stream_calibrated": q_stream_calibrated,
    "lookup_scan": q_lookup_scan,
    "detailed_readback": q_detailed_readback,
    "metrics_json": q_metrics_json,
    "report_table": q_report_table,
}

# --------------------------------------------------------------------------- oracle
_TR = "ln(abs(reading) + 1) * sin(reading)"
_BASE = (
    f"WITH r AS ({fx.SQL_READINGS}), m AS ({fx.SQL_METADATA}), l AS ({fx.SQL_LOOKUP}), "
    f"v AS (SELECT sensor_id, reading, \"timestamp\", {_TR} AS transformed_reading FROM r "
    f"WHERE reading IS NOT NULL AND {_TR} IS NOT NULL), "
    "j AS (SELECT l.device_type, v.sensor_id, v.reading, v.\"timestamp\", v.transformed_reading, m.location, "
    "l.calibration_factor, v.transformed_reading * l.calibration_factor AS calibrated_reading "
    "FROM v LEFT JOIN m ON v.sensor_id = m.sensor_id LEFT JOIN l ON m.device_type = l.device_type) "
)
# the second USING join keeps the left key; rewrite it as the left side's device_type
_BASE = _BASE.replace("SELECT l.device_type, v.sensor_id", "SELECT m.device_type, v.sensor_id")
_RANK = "CAST(rank() OVER (PARTITION BY location ORDER BY \"timestamp\" ASC NULLS FIRST) AS INTEGER)"
_DET_COLS = ("device_type, sensor_id, reading, \"timestamp\", round(transformed_reading, 6) AS transformed_reading, "
             "location, calibration_factor, round(calibrated_reading, 6) AS calibrated_reading")
_AGG = ("SELECT location, round(avg(calibrated_reading), 6) AS avg_calibrated, "
        "round(max(calibrated_reading), 6) AS max_calibrated FROM j GROUP BY location")

ORACLE = {
    "sensor_scan": fx.SQL_READINGS,
    "metadata_scan": fx.SQL_METADATA,
    "transform_reading": f"SELECT sensor_id, reading, \"timestamp\", round({_TR}, 6) AS transformed_reading "
                         f"FROM ({fx.SQL_READINGS})",
    "valid_readings": _BASE + "SELECT sensor_id, reading, \"timestamp\", round(transformed_reading, 6) "
                              "AS transformed_reading FROM v",
    "join_metadata": _BASE + "SELECT v.sensor_id, reading, \"timestamp\", round(transformed_reading, 6) AS "
                             "transformed_reading, location, device_type FROM v LEFT JOIN m ON v.sensor_id = m.sensor_id",
    "join_lookup": _BASE + "SELECT device_type, sensor_id, reading, \"timestamp\", round(transformed_reading, 6) "
                           "AS transformed_reading, location, calibration_factor FROM j",
    "calibrated": _BASE + f"SELECT {_DET_COLS} FROM j",
    "reading_rank": _BASE + f"SELECT {_DET_COLS}, {_RANK} AS reading_rank FROM j",
    "reading_rank_window": _BASE + f"SELECT {_DET_COLS}, {_RANK} AS reading_rank FROM j",
    "reading_rank_ties": _BASE + f"SELECT {_DET_COLS}, CAST(\"timestamp\" // 3600 AS INTEGER) AS hour, "
                                 "CAST(rank() OVER (PARTITION BY location ORDER BY \"timestamp\" // 3600 "
                                 "ASC NULLS FIRST) AS INTEGER) AS hour_rank FROM j",
    "sensor_aggregated": _BASE + _AGG,
    "sensor_detailed": _BASE + f"SELECT {_DET_COLS}, {_RANK} AS reading_rank, "
                               f"'{AS_OF.isoformat()}' AS processing_time, "
                               f"'{AS_OF.strftime('%Y-%m-%d')}' AS processing_date FROM j",
    "table_roundtrip": _BASE + _AGG,
    "run_report": _BASE + (
        "SELECT * FROM ("
        "SELECT 'read' AS stage, 'lookup_records' AS metric, (SELECT count(*) FROM l) AS value "
        "UNION ALL SELECT 'read', 'sensor_records', (SELECT count(*) FROM r) "
        "UNION ALL SELECT 'read', 'metadata_records', (SELECT count(*) FROM m) "
        "UNION ALL SELECT 'transform', 'valid_sensor_records', (SELECT count(*) FROM v) "
        "UNION ALL SELECT 'join', 'joined_records', (SELECT count(*) FROM j) "
        "UNION ALL SELECT 'write:detailed', 'records_written', (SELECT count(*) FROM j) "
        "UNION ALL SELECT 'write:detailed', 'write_operations', 1 "
        "UNION ALL SELECT 'window', 'locations_analyzed', (SELECT count(DISTINCT coalesce(location, '<null>')) FROM j) "
        "UNION ALL SELECT 'write:aggregated', 'records_written', (SELECT count(DISTINCT coalesce(location, '<null>')) FROM j) "
        "UNION ALL SELECT 'write:aggregated', 'write_operations', 2 "
        "UNION ALL SELECT 'final', 'final_records', (SELECT count(*) FROM j))"
    ),
    "table_clone": fx.SQL_METADATA,
}
ORACLE["stream_calibrated"] = ORACLE["calibrated"]
ORACLE["lookup_scan"] = fx.SQL_LOOKUP
ORACLE["detailed_readback"] = ORACLE["sensor_detailed"]
ORACLE["report_table"] = (f"SELECT *, false AS failed FROM ({ORACLE['run_report']}) "
                          "UNION ALL SELECT 'read', NULL, NULL, true")
# of a metric that several stages give the last counts
ORACLE["metrics_json"] = (f"SELECT metric, max(value) AS value FROM ({ORACLE['run_report']}) "
                          "WHERE stage <> 'write:detailed' GROUP BY metric")
