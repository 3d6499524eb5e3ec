"""The sensor job, lazily (``sensor_pipeline``) or as a run with sinks
and a report (``run_sensor_job``)."""

from __future__ import annotations

import datetime as _dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import sensor as ops
from quarry.operators.report import RunLog
from quarry.operators.sinks import parquet_rows, table_location, write_table
from quarry.sources import sensor as src


@dataclass
class SensorJobConfig:
    """Where a run reads and writes.  Fixed values: the names of the job's eight settings."""

    sensor_data_path: str
    metadata_path: str
    lookup_path: str
    detailed_output_path: str
    aggregated_output_path: str
    database: str
    detailed_table: str
    aggregated_table: str


@dataclass
class SensorRun:
    detailed: DataFrame
    aggregated: DataFrame
    report: DataFrame


def sensor_pipeline(
    readings: DataFrame,
    metadata: DataFrame,
    lookup: DataFrame,
    as_of: _dt.datetime | None = None,
    rank_strategy: str = "auto",
) -> tuple[DataFrame, DataFrame]:
    """(detailed, aggregated), both lazy; the aggregate never sees the rank."""
    valid = ops.transform_readings(readings)
    joined = ops.calibrated_readings(valid, metadata, lookup)
    aggregated = ops.location_summary(joined)
    detailed = ops.enrich_with_time(ops.rank_readings(joined, strategy=rank_strategy), as_of)
    return detailed.select(*ops.DETAILED_COLUMNS), aggregated


def run_sensor_job(
    spark: SparkSession,
    cfg: SensorJobConfig,
    as_of: _dt.datetime | None = None,
    run_id: str | None = None,
    inputs: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    rank_strategy: str = "auto",
    partition_by: list[str] | None = None,
) -> SensorRun:
    """Read, transform, join, rank, aggregate and write both tables, with a report.

    Two jobs write data: the detailed table (scan -> joins -> rank), then the
    aggregate, which reads back only ``location`` and ``calibrated_reading``
    of the written detailed table instead of recomputing the joins.  Input and
    output row counts come from Parquet footers (exact, no data read); the
    count after the null filter scans one column.  A failure is recorded in the
    report and re-raised.
    """
    log = RunLog(run_id or uuid.uuid4().hex[:12])
    stage = "read"
    try:
        if inputs is None:
            readings = src.read_sensor_data(spark, cfg.sensor_data_path)
            metadata = src.read_metadata(spark, cfg.metadata_path)
            lookup = src.read_lookup(spark, cfg.lookup_path)
            # exact and cheap: Parquet row counts come from the file footers
            log.metric("read", "sensor_records", parquet_rows(spark, cfg.sensor_data_path))
            log.metric("read", "metadata_records", parquet_rows(spark, cfg.metadata_path))
        else:
            readings, metadata, lookup = inputs
            log.metric("read", "sensor_records", readings.count())
            log.metric("read", "metadata_records", metadata.count())
        log.metric("read", "lookup_records", lookup.count())

        stage = "transform"
        valid = ops.transform_readings(readings)
        log.metric("transform", "valid_sensor_records", valid.count())
        stage = "join"
        joined = ops.calibrated_readings(valid, metadata, lookup)
        stage = "window"
        detailed = ops.enrich_with_time(ops.rank_readings(joined, strategy=rank_strategy), as_of)
        detailed = detailed.select(*ops.DETAILED_COLUMNS)

        stage = "write"
        name = write_table(detailed, cfg.database, cfg.detailed_table, cfg.detailed_output_path,
                           partition_by=partition_by)
        written = parquet_rows(spark, table_location(spark, name))
        log.metric("join", "joined_records", written)
        log.metric("write:detailed", "records_written", written)
        log.metric("write:detailed", "write_operations", 1)

        aggregated = ops.location_summary(spark.table(name).select("location", "calibrated_reading"))
        summary = write_table(aggregated, cfg.database, cfg.aggregated_table, cfg.aggregated_output_path)
        groups = parquet_rows(spark, table_location(spark, summary))
        log.metric("window", "locations_analyzed", groups)
        log.metric("write:aggregated", "records_written", groups)
        log.metric("write:aggregated", "write_operations", 2)
        log.metric("final", "final_records", written)
    except Exception as exc:  # recorded, then re-raised with the report attached
        log.error(stage, f"{type(exc).__name__}: {exc}")
        exc.run_report = log.to_df(spark)
        raise
    report = log.to_df(spark)
    return SensorRun(
        detailed=spark.table(name),
        aggregated=spark.table(summary),
        report=report,
    )


def write_report(report: DataFrame, database: str | None, table: str, path: str) -> None:
    """Append a run's report rows to a report table."""
    write_table(report.withColumn("logged_at", F.current_timestamp()), database, table, path, mode="append")
