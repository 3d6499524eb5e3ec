"""Run report: stage counts, writer counts and errors as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("stage", T.StringType(), False),
    T.StructField("metric", T.StringType(), True),
    T.StructField("value", T.LongType(), True),
    T.StructField("error", T.StringType(), True),
])


@dataclass
class RunLog:
    """Collects metric and error rows on the driver (a handful per run)."""

    run_id: str
    rows: list[tuple] = field(default_factory=list)

    def metric(self, stage: str, metric: str, value: int) -> None:
        self.rows.append((self.run_id, len(self.rows), stage, metric, int(value), None))

    def error(self, stage: str, message: str) -> None:
        self.rows.append((self.run_id, len(self.rows), stage, None, None, message))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, REPORT_SCHEMA)


def metrics_json(report: DataFrame) -> DataFrame:
    """One pretty JSON object per run: ``{metric: value}``; a repeated metric keeps its last value."""
    m = (report.filter(F.col("metric").isNotNull())
         .groupBy("run_id", "metric").agg(F.max_by("value", "seq").alias("value")))
    return m.groupBy("run_id").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))), {"pretty": "true"}).alias("metrics")
    )
