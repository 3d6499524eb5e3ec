"""The counted rank equals rank() over a window on all columns, also when one group holds most rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.rank import rank_within, with_splitter_buckets

SCHEMA = "g string, t int, id long, big long, x double"


def _data(spark, n=4000, seed=7):
    rng = np.random.default_rng(seed)
    groups = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c", "none"], n))
    ts = rng.integers(-200_000, 900_000, n) // 500 * 500
    special = [float("nan"), float("inf"), -0.0, None, 1.5]
    rows = [(None if g == "none" else str(g), None if rng.random() < 0.02 else int(t), i, None if i % 7 == 0 else 2 ** 60 + i,
             special[i % 5]) for i, (g, t) in enumerate(zip(groups, ts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()), key=lambda r: r[2])


@pytest.mark.parametrize("width", [1, 86_400, 10_000_000])
def test_equals_the_window_on_all_columns(spark, width):
    df = _data(spark)
    plain = rank_within(df, "g", "t", "r", strategy="window")
    counted = rank_within(df, "g", "t", "r", bucket_width=width)
    assert counted.schema["r"].dataType == plain.schema["r"].dataType and counted.columns == plain.columns
    assert _rows(counted) == _rows(plain)


@pytest.mark.parametrize("kind", ["string", "double", "timestamp", "date", "bigint"])
def test_other_order_types(spark, kind):
    df = _data(spark, 600).withColumn("t", (F.timestamp_seconds("t") if kind in ("timestamp", "date") else F.col("t")).cast(kind))
    assert _rows(rank_within(df, "g", "t", "r")) == _rows(rank_within(df, "g", "t", "r", strategy="window"))


def test_all_ties_and_empty(spark):
    df = spark.createDataFrame([("x", 5, i) for i in range(500)] + [("x", 6, 1000)], "g string, t int, id long")
    got = {r.id: r.r for r in rank_within(df, "g", "t", "r").collect()}
    assert {v for k, v in got.items() if k < 1000} == {1} and got[1000] == 501
    assert rank_within(df.limit(0), "g", "t", "r").count() == 0


def test_plan_is_built_in(spark):
    plan = rank_within(_data(spark, 200), "g", "t", "r")._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan and "Scan ExistingRDD checkpoint" not in plan
    assert isinstance(rank_within(_data(spark, 5), "g", "t", "r").schema["big"].dataType, T.LongType)


@pytest.mark.parametrize("kind", ["string", "double", "date", "timestamp_ntz", "decimal(20,3)", "bigint", "binary"])
def test_hot_group_is_cut_at_its_own_values(spark, kind):
    rng = np.random.default_rng(3)
    n = 12_000
    values = [None if i % 50 == 0 else int(rng.integers(-10 ** 9, 10 ** 9)) if i % 3 else 7 for i in range(n)]
    df = spark.createDataFrame([("hot" if i % 10 < 6 else f"g{i % 7}", v, i) for i, v in enumerate(values)], "g string, t long, id long")
    t = F.col("t")
    if kind in ("date", "timestamp_ntz"):
        t = F.timestamp_seconds(t).cast(kind)
    elif kind == "string":
        t = F.concat(F.lit("a long common prefix "), t.cast("string"))
    elif kind == "binary":
        t = t.cast("string").cast("binary")
    else:
        t = t.cast(kind)
    df = df.withColumn("t", t)
    assert _rows(rank_within(df, "g", "t", "r", values_per_bucket=500)) == _rows(rank_within(df, "g", "t", "r", strategy="window"))
    counts = df.groupBy(F.col("g").alias("__g"), F.col("t").alias("__o")).agg(F.count("*").alias("__n"))
    hot = with_splitter_buckets(counts, 500).filter("__g = 'hot' AND __b >= 0").groupBy("__b").count().collect()
    sizes = [r["count"] for r in hot]
    assert len(sizes) >= 6 and max(sizes) <= 1.6 * np.mean(sizes)
    one = with_splitter_buckets(counts.filter("__g <> 'hot'"), 1 << 18).agg(F.max("__b")).first()[0]
    assert one == 0
