"""Shipping of the package and removal of scratch tables."""

import subprocess
import sys
import zipfile

from quarry import session


def test_zip_holds_texts_too(spark):
    session.ship_package(spark)
    with zipfile.ZipFile(session._ZIP) as z:
        names = z.namelist()
    assert "quarry/session.py" in names and not any(n.endswith(".pyc") for n in names)


def test_scratch_is_removed(tmp_dir):
    code = f"""
from pyspark.sql import SparkSession
from quarry.session import materialize, remove_scratch, scratch_path
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_dir}/ck").getOrCreate()
df = materialize(spark.range(3), "x")
assert df.count() == 3 and "{tmp_dir}/ck" in scratch_path(spark, "y")
assert remove_scratch(spark) and not remove_scratch(spark)
assert materialize(spark.range(4), "x").count() == 4
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
