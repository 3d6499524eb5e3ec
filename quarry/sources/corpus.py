"""A script corpus derived from ``customer``: one program per customer row.

The program text is built by string functions from the row's columns, so the
corpus grows with the table and the right answer of every query over it is
plain SQL over ``customer``.  ``c_custkey % 8`` picks one of eight shapes;
every row yields a program (nothing is filtered out).

Shapes (k = c_custkey, s = lower(c_mktsegment), n = c_nationkey):

0  bare ``load`` of a literal path; a chained reader ``load``; a ``saveAsTable``
1  import alias + dotted receiver, path in a variable, f-string table name
2  path from a dict-literal entry passed as a parameter; keyword from a dict entry
3  a ``load`` in each arm of an ``if``
4  f-string with an undefined name
5  syntax error
6  the same call twice with keywords swapped; tab and common indent
7  a ``load`` inside a function nobody calls

``flow_scripts`` has ten more shapes, by ``c_custkey % 10``:

0  a static method with a default, called through its class
1  a constructor's argument and default kept in attributes, used by a method
2  a path bound again in an ``if``
3  a part of a path bound again in a loop, below its use
4  a call with a starred argument before a literal, and one without
5  functions handed on: in a dict and to a decorator; one that nobody gets
6  ``with`` and a property; a method that nobody reads
7  readers that are aliases of an import; one that is not
8  a function called in the first arm only, one in the other only
9  a function called through another name, with and without its default
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.fixtures import table


def _cat(*parts) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


def _corpus(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """One program per customer row: ``make(k, s, n)`` gives the shapes, picked by ``c_custkey``."""
    c = table(spark, sf_dir, "customer")
    shapes = make(F.col("c_custkey").cast("string"), F.lower(F.col("c_mktsegment")), F.col("c_nationkey").cast("string"))
    shape = F.col("c_custkey") % len(shapes)
    source = F.when(shape == 0, shapes[0])
    for i, body in enumerate(shapes[1:], start=1):
        source = source.when(shape == i, body)
    key = F.col("c_custkey").cast("long")
    return c.select(key.alias("script_id"), key.alias("script_ord"), source.alias("source"))


def flow_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shapes(k, s, n):
        return [
            _cat('class Paths:\n    @staticmethod\n    def read(base, name="c', k, '"):\n        load(f"{base}/{name}")\n',
                 'Paths.read("s3a://', s, '")\nPaths.read("s3a://', s, '", name="n', n, '")\n'),
            _cat('class Job:\n    def __init__(self, root, mode="overwrite"):\n        self.root = root\n        self.mode = mode\n',
                 '    def run(self, table):\n        self.frame.write.saveAsTable(f"{self.root}.{table}", mode=self.mode)\n',
                 'Job("db_', s, '").run("t', k, '")\n'),
            _cat('path = "s3a://', s, '/a"\nif flag:\n    path = "s3a://', s, '/b', k, '"\nload(path)\n'),
            _cat('part = "p0"\nfor day in days:\n    load(f"s3a://', s, '/{part}")\n    part = "p', n, 'x"\n'),
            _cat('def copy(a, b, c="x"):\n    load(b)\n    load(c)\n',
                 'copy(*sources, "s3a://', s, '/c', k, '")\ncopy("s3a://', s, '/a", "s3a://', s, '/b', k, '")\n'),
            _cat('def first():\n    load("s3a://', s, '/first', k, '")\n@register\ndef second():\n    load("s3a://', s, '/second', k, '")\n',
                 'def third():\n    load("s3a://', s, '/third', k, '")\nsteps = {"a": first}\nsteps["a"]()\n'),
            _cat('class Lake:\n    def __enter__(self):\n        load("s3a://', s, '/enter', k, '")\n    def __exit__(self, *error):\n        pass\n',
                 '    @property\n    def frame(self):\n        return load("s3a://', s, '/frame', k, '")\n',
                 '    def never(self):\n        load("s3a://', s, '/never', k, '")\nwith Lake() as lake:\n    lake.frame\n'),
            _cat('import pyspark.sql as ps\nsession = ps.get()\nreader = session.read\n',
                 'reader.option("k", ', k, ').load("s3a://', s, '/r', k, '")\nother.read().load("s3a://', s, '/o', k, '")\n'),
            _cat('def old():\n    load("s3a://', s, '/old', k, '")\ndef new():\n    load("s3a://', s, '/new', k, '")\n',
                 'if ready:\n    new()\nelse:\n    old()\n'),
            _cat('def read(path, fmt="parquet"):\n    return load(path, format=fmt)\nfetch = read\n',
                 'fetch("s3a://', s, '/c', k, '")\nfetch("s3a://', s, '/d', k, '", "csv")\n'),
        ]
    return _corpus(spark, sf_dir, shapes)


def templated_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    s = F.lower(F.col("c_mktsegment"))
    n = F.col("c_nationkey").cast("string")
    shapes = [
        _cat('import pyspark.sql.functions as F\n',
             'df = load("s3a://lake/', s, '/c', k, '.parquet")\n',
             'df.write.saveAsTable("analytics.c', k, '")\n',
             'raw = spark.read.format("csv").load("s3a://lake/', s, '/raw', k, '.csv")\n'),
        _cat('import pyspark.sql as ps\n',
             'src = "s3a://lake/', s, '/n', n, '/c', k, '"\n',
             'db = "lake_', s, '"\n',
             'frame = ps.session.read.load(src)\n',
             'frame.write.mode("overwrite").saveAsTable(f"{db}.t', k, '")\n'),
        _cat('cfg = {"src": "s3a://lake/', s, '/cfg', k, '", "fmt": "parquet"}\n',
             'def run(path):\n',
             '    return load(path, format=cfg["fmt"])\n',
             'run(cfg["src"])\n'),
        _cat('import sys\n',
             'if __name__ == "__main__":\n',
             '    load("s3a://lake/', s, '/a")\n',
             'else:\n',
             '    load("s3a://lake/', s, '/b")\n'),
        _cat('path = f"s3a://lake/{region}/c', k, '"\n',
             'load(path)\n'),
        _cat('def broken(:\n',
             '    load("s3a://lake/', s, '/x', k, '")\n'),
        _cat('    load("s3a://lake/', s, '/d', k, '", header=True, sep=",")\n',
             '\tload("s3a://lake/', s, '/d', k, '", sep=",", header=True)\n'),
        _cat('def unused():\n',
             '    return load("s3a://lake/', s, '/u', k, '")\n'),
    ]
    shape = F.col("c_custkey") % 8
    source = F.when(shape == 0, shapes[0])
    for i, body in enumerate(shapes[1:], start=1):
        source = source.when(shape == i, body)
    return c.select(
        F.col("c_custkey").cast("long").alias("script_id"),
        F.col("c_custkey").cast("long").alias("script_ord"),
        source.alias("source"),
    )
