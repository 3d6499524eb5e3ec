"""Script corpora as ``scripts(script_id, script_ord, source)``.

Any table with a text column is a corpus (``scripts_from_table``); a folder of
files is one too (``scripts_from_files``, one whole file per row).  Sources
are always read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.ordinals import with_ordinals

SCRIPT_SCHEMA = T.StructType([
    T.StructField("script_id", T.LongType(), False),
    T.StructField("script_ord", T.LongType(), False),
    T.StructField("source", T.StringType(), True),
])


def scripts_from_table(df: DataFrame, id_col: str, source_col: str, ord_col: str | None = None) -> DataFrame:
    return df.select(
        F.col(id_col).cast("long").alias("script_id"),
        F.col(ord_col or id_col).cast("long").alias("script_ord"),
        F.col(source_col).cast("string").alias("source"),
    )


def scripts_from_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, whole text, numbered in the order of the file paths (``script_ord`` from 0).

    The ids come from the paths, so reruns agree.  Only paths are sorted; texts
    are read once and joined to their numbers.
    """
    named = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    numbered = with_ordinals(named, F.col("file"), out="script_ord")
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("source"), F.col("_metadata.file_path").alias("file"))
    return raw.join(numbered, "file").select(F.xxhash64("file").alias("script_id"), "script_ord", "source", "file")


def targets_frame(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(set(names))], "function string")
