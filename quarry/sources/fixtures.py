"""Views of the shared test tables in the shapes the jobs expect.

Sensor shapes (all derived by Spark from the tables, so they grow with them):

* readings  <- ``events``: ``user_id`` as text, ``value``, epoch seconds of ``ts``;
* metadata  <- ``customer`` joined to ``nation`` for the location;
* lookup    <- the distinct device types of ``customer`` with a factor of their name's length.

Unmatched sensors and device types are left to pytest: the shared tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_seconds(ts_col: str) -> F.Column:
    """Whole seconds since 1970-01-01 of a timestamp_ntz, independent of the session time zone."""
    return F.expr(f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  f"CAST({ts_col} AS TIMESTAMP_NTZ)) AS INT)")


def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("sensor_id"),
        F.col("value").cast("double").alias("reading"),
        epoch_seconds("ts").alias("timestamp"),
    )


def sensor_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey, "inner").select(
        F.col("c_custkey").cast("string").alias("sensor_id"),
        F.col("n_name").alias("location"),
        F.col("c_mktsegment").alias("device_type"),
    )


def calibration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("device_type"), (F.length("c_mktsegment") / 8).alias("calibration_factor")).distinct()


def sensor_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return sensor_readings(spark, sf_dir), sensor_metadata(spark, sf_dir), calibration_lookup(spark, sf_dir)


# SQL twins of the views above, for the DuckDB oracle.
SQL_READINGS = ("SELECT CAST(user_id AS VARCHAR) AS sensor_id, CAST(value AS DOUBLE) AS reading, "
                "CAST(epoch_us(ts) // 1000000 AS INTEGER) AS \"timestamp\" FROM events")
SQL_METADATA = ("SELECT CAST(c_custkey AS VARCHAR) AS sensor_id, n_name AS location, c_mktsegment AS device_type "
                "FROM customer JOIN nation ON c_nationkey = n_nationkey")
SQL_LOOKUP = "SELECT DISTINCT c_mktsegment AS device_type, length(c_mktsegment) / 8.0::DOUBLE AS calibration_factor FROM customer"
