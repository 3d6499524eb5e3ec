"""The stateless part of the sensor job over readings that arrive as files.

Readings files land in a folder; each micro-batch is transformed, filtered,
left-joined to the (static) metadata and calibration tables and appended to
a Parquet folder.  Progress and exactly-once file output live in the
``checkpointLocation`` (a shared folder).  The rank and the per-location
aggregate look at the whole history of a location, so they stay batch jobs
over the written output (``quarry.plans.sensor``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import sensor as ops
from quarry.sources.sensor import SENSOR_SCHEMA


def calibrated_stream(spark: SparkSession, readings_dir: str, metadata: DataFrame, lookup: DataFrame,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SENSOR_SCHEMA).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    readings = reader.load(readings_dir)
    return ops.calibrated_readings(ops.transform_readings(readings), metadata, lookup)


def start_sensor_stream(spark: SparkSession, readings_dir: str, metadata: DataFrame, lookup: DataFrame,
                        output_dir: str, checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    out = calibrated_stream(spark, readings_dir, metadata, lookup)
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(output_dir)
