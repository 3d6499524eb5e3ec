"""Session helpers.

The library never creates its own cluster session: every builder takes the
caller's ``SparkSession``.  ``local_session`` is for tests, the bench and the
examples only.  ``checkpoint_root`` reads the shared folder the cluster names in
``spark.checkpoint.dir``; a machine-local default is set only when the setting
is absent and the master is local (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="quarry-wh-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()
_ZIP: str | None = None


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable on the executors' Python workers (like ``--py-files``).

    The steps that run Python on executors (the script parse, the rank's
    partition pass) pickle functions by module reference, so the workers must
    import ``quarry`` whatever the driver's working directory.  The package is
    zipped once per driver process and added once per Spark application.
    """
    global _ZIP
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if _ZIP is None:
        import zipfile
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        path = os.path.join(tempfile.mkdtemp(prefix="quarry-py-"), "quarry.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
            for base, _, files in os.walk(pkg):
                for f in files:
                    if not f.endswith(".pyc"):            # also texts that modules read
                        full = os.path.join(base, f)
                        zf.write(full, os.path.relpath(full, root))
        _ZIP = path
    sc.addPyFile(_ZIP)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch tables.

    Uses ``spark.checkpoint.dir`` (or the context's checkpoint dir) when the
    cluster sets one.  Only a local master may fall back to a fresh temporary
    folder; on a cluster an unset dir is an error, since a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(_CHECKPOINT_KEY, None)
    if not current:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS)"
            )
        current = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/quarry-scratch/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> bool:
    """Deletes what this application wrote to the shared folder by ``materialize`` and ``scratch_path``.

    For the end of a job, when no DataFrame of this library is read any more and
    no table points into the folder.  Returns whether there was anything.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark).rstrip('/')}/quarry-scratch")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(folder) and system.delete(folder, True))


def materialize(df, name: str, partition_by: list[str] | None = None):
    """Write ``df`` as Parquet in the shared folder and read it back.

    Ends the plan like ``checkpoint()`` but keeps column pruning, filter
    pushdown and (with ``partition_by``) partition pruning for every consumer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

