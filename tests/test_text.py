import textwrap

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import dedent_text, expand_tabs

CASES = [
    "    a = 1\n    b = 2\n",
    "  x\n\n      y\n  z",
    "no indent\n  here\n",
    "    only\n   \n    blank-ish\n",
    "\tt = 1\n    u = 2\n",
    "",
]


@pytest.mark.parametrize("src", CASES)
def test_native_dedent_equals_textwrap(spark, src):
    df = spark.createDataFrame([(src,)], "s string")
    got = df.select(dedent_text(expand_tabs("s")).alias("d")).first().d
    assert got == textwrap.dedent(src.replace("\t", "    "))


def test_whole_text_no_prefix(spark):
    big = "\n".join(f"    line_{i} = {i}" for i in range(20000))
    df = spark.createDataFrame([(big,)], "s string")
    got = df.select(dedent_text("s").alias("d")).first().d
    assert got == textwrap.dedent(big) and got.count("\n") == 19999
