"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; all other characters belong to words.
SPACES = " \t\n\x0b\f\r"
NOT_WORD = r"[\x20\x09-\x0D]+"
#: Rows in one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # shuffle files of a finished query are of no more use here: what is read again is written as a table
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_pieces(arrays: list, schema: pa.Schema, rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """Long numpy columns as batches of limited length."""
    n = len(arrays[0])
    for k in range(0, n, rows):
        yield record_batch(schema, [a[k : k + rows] for a in arrays])
