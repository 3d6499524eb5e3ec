"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint_root, materialize, ship_package

__all__ = ["BUCKETS", "cut", "documents", "fold", "free_name", "in_buckets", "prepared", "ranks_bytes", "same_row", "table",
           "with_text_columns", "without_rows"]

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
#: Hash buckets of rows that are looked for: at most this many numbers are broadcast.
BUCKETS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder and this package on the executors' Python path."""
    checkpoint_root(spark)
    ship_package(spark)
    return spark


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that its plan ends there."""
    return materialize(df, name)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_row(docs: DataFrame, rows: DataFrame, text: str, ident: str) -> Column:
    """Join condition: a row of ``docs`` has the id and text hash of (id, text_hash) in ``rows``."""
    return docs[ident].eqNullSafe(rows["id"]) & (F.xxhash64(docs[text]) == rows["text_hash"])


def in_buckets(docs: DataFrame, rows: DataFrame, text: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` that may be among ``rows`` (how: left_semi), or cannot be (left_anti), without a shuffle.

    Only the distinct buckets of the text hashes are broadcast, never more than
    ``BUCKETS``; where all are taken every row may be among them.
    """
    taken = rows.select(F.pmod("text_hash", F.lit(BUCKETS)).alias("__bucket")).distinct()
    return docs.join(F.broadcast(taken), F.pmod(F.xxhash64(docs[text]), F.lit(BUCKETS)) == taken["__bucket"], how)


def without_rows(docs: DataFrame, rows: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` without those whose id and text hash are in ``rows``; most texts are not shuffled."""
    maybe = in_buckets(docs, rows, text)
    return in_buckets(docs, rows, text, "left_anti").unionByName(maybe.join(rows, same_row(maybe, rows, text, ident), "left_anti"))


def ranks_bytes(path: str) -> bytes:
    """A vocabulary file's bytes, read on the driver: executors get them with the task."""
    with open(path, "rb") as f:
        return f.read()


def with_text_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[bytes | None]], list[list]]],
    source: str = "text",
    drop: bool = False,
) -> DataFrame:
    """``df`` plus columns computed from one string or binary column, in Arrow batches.

    ``make()`` runs once per task and gives a function from a list of UTF-8
    values (None for null) to one list per field.  A column of ``df`` with the
    name of a new field is replaced.  ``drop`` leaves the source column out.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new and not (drop and c == source)]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep] + fields)
    hidden = free_name(df, "__in")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute, out_types = make(), None
        for batch in batches:
            part = values = None
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                values = compute(part.column(len(keep)).to_pylist())
                if out_types is None:
                    from pyspark.sql.pandas.types import to_arrow_type

                    out_types = [to_arrow_type(f.dataType) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(v, type=t) for v, t in zip(values, out_types, strict=True)],
                    names=keep + [f.name for f in fields],
                )
            # what this batch took goes back to the system before the next one comes
            del batch, part, values
            pa.default_memory_pool().release_unused()

    return df.select(*keep, F.col(source).cast("binary").alias(hidden)).mapInArrow(run, schema)
