"""Table sinks, the create-if-absent clone and the run report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators.report import metrics_json
from quarry.operators.sinks import clone_table, remove_versions, table_location, write_table
from quarry.plans.sensor import SensorJobConfig, run_sensor_job
from quarry.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_sink_is_external_table(spark, tmp_dir):
    df = spark.range(5).withColumnRenamed("id", "v")
    name = write_table(df, "quarry_t", "ext_tbl", f"{tmp_dir}/ext")
    assert spark.table(name).count() == 5
    desc = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    assert desc.get("Type") == "EXTERNAL"


def test_clone_create_then_exists_then_missing(spark, tmp_dir):
    src = write_table(spark.range(3), "quarry_t", "clone_src", f"{tmp_dir}/src")
    first = clone_table(spark, src, "quarry_t.clone_dst", path=f"{tmp_dir}/dst").first()
    second = clone_table(spark, src, "quarry_t.clone_dst").first()
    assert (first.status, second.status) == ("created", "exists")
    assert spark.table("quarry_t.clone_dst").count() == 3
    with pytest.raises(ValueError):
        clone_table(spark, "quarry_t.no_such_table", "quarry_t.other")


def _cfg(tmp_dir, tag):
    return SensorJobConfig(
        sensor_data_path=f"{tmp_dir}/in/sensor", metadata_path=f"{tmp_dir}/in/meta", lookup_path=f"{tmp_dir}/in/lookup",
        detailed_output_path=f"{tmp_dir}/out/detailed", aggregated_output_path=f"{tmp_dir}/out/aggregated",
        database="quarry_iot", detailed_table=f"detailed_{tag}", aggregated_table=f"aggregated_{tag}")


def test_run_from_parquet_paths(spark, tmp_dir):
    r, m, l = fx.sensor_inputs(spark, SF)
    cfg = _cfg(tmp_dir, "p")
    r.write.parquet(cfg.sensor_data_path)
    m.write.parquet(cfg.metadata_path)
    l.write.parquet(cfg.lookup_path)
    run = run_sensor_job(spark, cfg, as_of=dt.datetime(2024, 1, 1))
    rep = {(x.stage, x.metric): x.value for x in run.report.collect()}
    n = r.count()
    assert rep[("read", "sensor_records")] == n
    assert rep[("read", "metadata_records")] == m.count()
    assert rep[("read", "lookup_records")] == l.count()
    assert rep[("transform", "valid_sensor_records")] == n
    assert rep[("final", "final_records")] == run.detailed.count() == rep[("join", "joined_records")]
    assert rep[("window", "locations_analyzed")] == run.aggregated.count()
    assert rep[("write:aggregated", "write_operations")] == 2
    assert spark.table("quarry_iot.detailed_p").count() == run.detailed.count()
    js = metrics_json(run.report).first().metrics
    assert '"write_operations" : 2' in js or '"write_operations": 2' in js


def test_failure_is_reported_and_reraised(spark, tmp_dir):
    cfg = _cfg(tmp_dir, "f")  # no input files were written
    with pytest.raises(Exception) as err:
        run_sensor_job(spark, cfg)
    report = err.value.run_report.collect()
    assert len(report) == 1 and report[0].stage == "read" and report[0].error


def failing(spark, n):
    """Rows whose last ones cannot be computed: the write dies half-way."""
    return spark.range(0, n, 1, 4).select(F.when(F.col("id") < n - 1, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("v"))


def test_a_failed_overwrite_keeps_the_old_rows(spark, tmp_dir):
    name = write_table(spark.range(3).withColumnRenamed("id", "v"), "quarry_t", "swap", f"{tmp_dir}/swap")
    before = table_location(spark, name)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            write_table(failing(spark, 1000), "quarry_t", "swap", f"{tmp_dir}/swap")
        assert sorted(r.v for r in spark.table(name).collect()) == [0, 1, 2] and table_location(spark, name) == before
    write_table(spark.range(5).withColumnRenamed("id", "v"), "quarry_t", "swap", f"{tmp_dir}/swap")
    assert spark.table(name).count() == 5 and table_location(spark, name) != before
    assert len(remove_versions(spark, name, f"{tmp_dir}/swap")) == 3 and spark.table(name).count() == 5


def test_overwrite_reads_the_table_that_it_replaces(spark, tmp_dir):
    name = write_table(spark.range(4).withColumnRenamed("id", "v"), "quarry_t", "own", f"{tmp_dir}/own")
    write_table(spark.table(name).filter("v > 1"), "quarry_t", "own", f"{tmp_dir}/own")
    assert sorted(r.v for r in spark.table(name).collect()) == [2, 3]


def test_overwrite_with_other_columns_and_partitions(spark, tmp_dir):
    write_table(spark.range(3).withColumnRenamed("id", "v"), "quarry_t", "shape", f"{tmp_dir}/shape")
    df = spark.range(6).select(F.col("id").cast("string").alias("name"), (F.col("id") % 2).alias("half"))
    name = write_table(df, "quarry_t", "shape", f"{tmp_dir}/shape", partition_by=["half"])
    assert spark.table(name).columns == ["name", "half"] and spark.table(name).filter("half = 1").count() == 3
    write_table(df.limit(0), "quarry_t", "shape", f"{tmp_dir}/shape")
    assert spark.table(name).count() == 0
    write_table(df, "quarry_t", "shape", f"{tmp_dir}/shape", mode="append")
    write_table(df, "quarry_t", "shape", f"{tmp_dir}/shape", mode="append")
    assert spark.table(name).count() == 12
    with pytest.raises(ValueError, match="mode"):
        write_table(df, "quarry_t", "shape", f"{tmp_dir}/shape", mode="replace")


@pytest.mark.parametrize("external", [True, False])
def test_a_failed_clone_can_be_repeated(spark, tmp_dir, external):
    tag = f"quarry_t.again_{external}"
    path = f"{tmp_dir}/again" if external else None
    failing(spark, 1000).createOrReplaceTempView(f"broken_{external}")
    with pytest.raises(Exception, match="lost"):
        clone_table(spark, f"broken_{external}", tag, path=path)
    assert not spark.catalog.tableExists(tag)
    spark.range(7).createOrReplaceTempView(f"broken_{external}")
    assert clone_table(spark, f"broken_{external}", tag, path=path).first().status == "created"
    assert spark.table(tag).count() == 7
