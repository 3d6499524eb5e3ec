"""Table sinks (S4, S5) and the create-if-absent table clone (S7), published by swap.

Rows are written to a folder of their own first; only when it is complete and
reads back with the columns that were meant does the table point to it.  A write
that fails leaves the table, its rows and its files as they were, and what it
leaves behind does not hinder its repetition.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = "version-"


def qualified_name(database: str | None, table: str) -> str:
    return f"{database}.{table}" if database else table


def table_location(spark: SparkSession, name: str) -> str:
    """The folder that a table points to."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def _columns(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name.lower(), f.dataType.simpleString()) for f in schema.fields]


def _partitioning(spark: SparkSession, name: str) -> list[str]:
    return [c.name.lower() for c in spark.catalog.listColumns(name) if c.isPartition]


def _write_version(df: DataFrame, path: str, partition_by: list[str]) -> str:
    """``df`` as Parquet in a new folder under ``path``; checked by reading its columns back."""
    version = f"{path.rstrip('/')}/{VERSION}{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(version)
    plain = [c for c in _columns(df.schema) if c[0] not in {p.lower() for p in partition_by}]
    if partition_by:
        return version                       # an empty table has no partition to read back
    found = _columns(df.sparkSession.read.parquet(version).schema)
    if found != plain:
        raise RuntimeError(f"{version} has the columns {found}, not {plain}")
    return version


def _publish(spark: SparkSession, name: str, version: str, schema: T.StructType, partition_by: list[str]) -> None:
    """Points ``name`` to ``version``: by its location alone if the table has these columns, else as a new external table."""
    parts = [p.lower() for p in partition_by]
    if spark.catalog.tableExists(name) and not parts and not _partitioning(spark, name) \
            and _columns(spark.table(name).schema) == _columns(schema) and spark.catalog.getTable(name).tableType == "EXTERNAL":
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        clause = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in partition_by)})" if partition_by else ""
        ordered = [f for f in schema.fields if f.name.lower() not in parts] + [f for f in schema.fields if f.name.lower() in parts]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {clause} LOCATION '{version}'")
        if partition_by:
            spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)


def write_table(df: DataFrame, database: str | None, table: str, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write ``df`` as Parquet under ``path`` and register it as ``database.table``; returns the name.

    The explicit path makes the table EXTERNAL: dropping it keeps the files.
    ``overwrite`` writes a version folder under ``path`` and moves the table to
    it, so read the table by its name (or ``table_location``).  ``append`` adds to
    the table where it is.  Earlier versions stay until ``remove_versions``.
    ``partition_by`` is off by default; pass e.g. ``["processing_date"]`` to get date-pruned reads.
    """
    spark = df.sparkSession
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    name = qualified_name(database, table)
    if mode == "append" and spark.catalog.tableExists(name):
        writer = df.write.format("parquet").mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
        return name
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    _publish(spark, name, _write_version(df, path, partition_by or []), df.schema, partition_by or [])
    return name


def remove_versions(spark: SparkSession, name: str, path: str) -> list[str]:
    """Deletes the version folders under ``path`` that the table does not point to; returns their names.

    For a time when no one reads the table: a reader that began before the last
    write still reads the version before it.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    current = table_location(spark, name).rstrip("/").rpartition("/")[2]
    gone = []
    for status in system.listStatus(folder):
        version = status.getPath().getName()
        if version.startswith(VERSION) and version != current and system.delete(status.getPath(), True):
            gone.append(version)
    return sorted(gone)


CLONE_STATUS_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("target", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("at", T.StringType(), False),
])


def clone_table(spark: SparkSession, source: str, target: str, path: str | None = None) -> DataFrame:
    """Copy a table's columns and rows under a new name unless the name is taken.

    A missing source is an error.  An existing target is left as it is and
    reported with status ``exists``; otherwise the copy is written (Parquet,
    external when ``path`` is given) and reported as ``created``.  The copy is
    one distributed read and write; nothing passes through the driver.  The
    target's name appears only when the copy is whole, so a clone that dies can
    be repeated.
    """
    if not spark.catalog.tableExists(source):
        raise ValueError(f"table {source} not found")
    at = _dt.datetime.now().isoformat()
    if spark.catalog.tableExists(target):
        status = "exists"
    else:
        rows = spark.table(source)
        if path:
            _publish(spark, target, _write_version(rows, path, []), rows.schema, [])
        else:
            draft = f"{target}_draft_{uuid.uuid4().hex[:12]}"
            rows.write.format("parquet").mode("errorifexists").saveAsTable(draft)
            spark.sql(f"ALTER TABLE {draft} RENAME TO {target}")
        status = "created"
    return spark.createDataFrame([(source, target, status, at)], CLONE_STATUS_SCHEMA)


def parquet_rows(spark: SparkSession, path: str) -> int:
    """Exact row count of written Parquet files; reads footers only."""
    return spark.read.parquet(path).count()
