import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows given as (doc_id, text[, lang, source]) -> a table with the columns of documents."""
    def make(rows, schema=SCHEMA):
        full = [tuple(r) + ("en", "src0")[len(r) - 2:] + (len(r[1] or ""),) for r in rows]
        return spark.createDataFrame(full, schema)
    return make


@pytest.fixture
def on_disk(spark, docs, tmp_dir):
    """Writes tables as a query finds them and gives the folder."""
    def write(rows, **more):
        docs(rows).write.mode("overwrite").parquet(f"{tmp_dir}/documents.parquet")
        for name, df in more.items():
            df.write.mode("overwrite").parquet(f"{tmp_dir}/{name}.parquet")
        return tmp_dir
    return write
