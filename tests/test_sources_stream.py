"""S6 corpora from whole files, and the streaming run of the job's stateless part."""

import os

from pyspark.sql import functions as F

from quarry.operators import sensor as ops
from quarry.operators.ordinals import with_ordinals
from quarry.plans.calls import extract_calls
from quarry.sources import fixtures as fx
from quarry.sources.scripts import scripts_from_files, targets_frame
from quarry.streaming import start_sensor_stream


def test_scripts_from_files_reads_whole_files(spark, tmp_dir):
    long_tail = "\n".join(f"x{i} = {i}" for i in range(3000))
    for name, body in {"a.py": f"{long_tail}\nload('s3a://x/a')\n", "b.py": "def f(:\n"}.items():
        with open(os.path.join(tmp_dir, name), "w") as fh:
            fh.write(body)
    scripts = scripts_from_files(spark, os.path.join(tmp_dir, "*.py"))
    assert scripts.count() == 2
    assert max(len(r.source) for r in scripts.collect()) > 20000  # never a prefix
    rows = extract_calls(scripts.drop("file"), targets_frame(spark, ["load"])).collect()
    assert [(r.function, r.args[0].value, r.line) for r in rows] == [("load", "s3a://x/a", 3001)]


def test_files_are_numbered_by_path(spark, tmp_dir):
    names = [f"s{i:02d} é.py" for i in range(23)]
    for i, name in enumerate(names):
        with open(os.path.join(tmp_dir, name), "w") as fh:
            fh.write(f"load({i // 2})\n")
    scripts = scripts_from_files(spark, os.path.join(tmp_dir, "*.py"))
    assert [r.source for r in scripts.orderBy("script_ord").collect()] == [f"load({i // 2})\n" for i in range(23)]
    assert sorted(r.script_ord for r in scripts.collect()) == list(range(23))
    # of equal calls the one of the first file stays
    first = {r.script_id: r.script_ord for r in scripts.collect()}
    rows = extract_calls(scripts.drop("file"), targets_frame(spark, ["load"])).collect()
    assert [first[r.script_id] for r in rows] == list(range(0, 23, 2))


def test_ordinals_of_ties_and_empty(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("ordinal"))
    got = with_ordinals(df, F.col("k"), start=1).collect()
    assert sorted(r.ordinal for r in got) == list(range(1, 1001))
    assert [r.k for r in sorted(got, key=lambda r: r.ordinal)] == sorted(i % 7 for i in range(1000))
    assert with_ordinals(df.limit(0), F.col("k")).count() == 0


def test_stream_matches_batch(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    r, m, l = fx.sensor_inputs(spark, sf)
    r.write.parquet(f"{tmp_dir}/in")
    q = start_sensor_stream(spark, f"{tmp_dir}/in", m, l, f"{tmp_dir}/out", f"{tmp_dir}/progress")
    q.awaitTermination()
    streamed = spark.read.parquet(f"{tmp_dir}/out")
    batch = ops.calibrated_readings(ops.transform_readings(r), m, l)
    cols = batch.columns
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.exceptAll(streamed.select(*cols)).count() == 0
