"""Declared-schema scans of the sensor job (no inference).

A Parquet file that lacks a declared column reads it as null; extra columns
are never read (the scan's ReadSchema is the declared one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The three input schemas of the sensor job (all nullable).
SENSOR_SCHEMA = T.StructType([
    T.StructField("sensor_id", T.StringType(), True),
    T.StructField("reading", T.DoubleType(), True),
    T.StructField("timestamp", T.IntegerType(), True),
])

METADATA_SCHEMA = T.StructType([
    T.StructField("sensor_id", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("device_type", T.StringType(), True),
])

LOOKUP_SCHEMA = T.StructType([
    T.StructField("device_type", T.StringType(), True),
    T.StructField("calibration_factor", T.DoubleType(), True),
])


def read_declared(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_sensor_data(spark: SparkSession, path: str) -> DataFrame:
    return read_declared(spark, path, SENSOR_SCHEMA)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_declared(spark, path, METADATA_SCHEMA)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return read_declared(spark, path, LOOKUP_SCHEMA)
