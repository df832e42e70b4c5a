"""A store of normalised results that micro-batches are published to, with durable signatures.

``rows/batch=<name>/bucket=<k>`` holds the rows of a batch, ``signatures/batch=<name>`` one row about it; a batch is part
of the store once its signature is there, which is one file and so appears at once.  A batch that died before that is
not seen and writes its own folder again.  Names are those of the watch (its checkpoint) and the batch, so a replay finds
its own signature and adds nothing.  Rows lie in buckets of experiments: a batch reads the stored rows of its own
buckets only, and no rows at all if another batch with the same content has been applied.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..contract import ROW_KEY, TABLES
from ..operators.changes import align, batch_signature
from ..operators.log_results import SAMPLE_KEY, VALUE_KEY, accept_in_order, as_results, log_cells, recorded_keys
from ..session import Run

BUCKETS = 64
SIGNATURE = "row_count bigint, signature string, appended bigint, status string"


def bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.trim(c)), F.lit(BUCKETS)).cast("int")


def batch_name(watch: str, batch_id: int) -> str:
    return f"{hashlib.sha256(watch.encode()).hexdigest()[:12]}-{batch_id:012d}"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """One row per published batch: ``batch``, content signature, rows appended, ``applied`` or ``identical``."""
    if not _exists(spark, f"{path}/signatures"):
        return spark.createDataFrame([], f"{SIGNATURE}, batch string")
    return spark.read.schema(f"{SIGNATURE}, batch string").parquet(f"{path}/signatures")


def stored(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """Result rows of all published batches, or of some buckets."""
    columns = TABLES["results"].schema()
    if not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], columns)
    rows = spark.read.schema(T.StructType([*columns.fields, T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/rows")
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    published = signatures(spark, path).where("status = 'applied'").select("batch")
    return rows.join(published, "batch", "left_semi").drop("batch", "bucket")


def publish(log: DataFrame, path: str, name: str, base: DataFrame | None = None) -> str:
    """Normalise a batch of log rows into the store; returns ``applied``, ``identical`` or ``replayed``.

    ``base`` are result rows that exist outside the store.
    """
    return publish_candidates(log_cells(log), path, name, base)


def publish_candidates(
    candidates: DataFrame, path: str, name: str, base: DataFrame | None = None, order: tuple[str, ...] = (ROW_KEY, "field_pos")
) -> str:
    """Publish the result rows of ``log_cells`` that no stored row and no row before them in ``order`` matches by either key."""
    spark = candidates.sparkSession
    known = signatures(spark, path)
    if not known.where(F.col("batch") == name).isEmpty():
        return "replayed"
    run = Run(spark)
    rows = run.cut(candidates.withColumn("bucket", bucket(F.col("experiment_id"))))
    own = batch_signature(as_results(rows).drop(*order))
    said = own.first()
    same = known.where((F.col("row_count") == said["row_count"]) & (F.col("signature") == said["signature"]) & (F.col("row_count") > 0))
    status = "applied" if same.isEmpty() else "identical"
    appended = 0
    if status == "applied" and said["row_count"]:
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most BUCKETS
        there = stored(spark, path, touched)
        if base is not None:
            there = there.unionByName(align(base, "results").where(bucket(F.col("experiment_id")).isin(touched)))
        fresh = accept_in_order(rows, SAMPLE_KEY, VALUE_KEY, list(order), *recorded_keys(there))
        fresh = run.cut(align(as_results(fresh), "results").withColumn("bucket", bucket(F.col("experiment_id"))))
        appended = fresh.count()
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={name}")
    line = spark.createDataFrame([(said["row_count"], said["signature"], appended, status)], SIGNATURE)
    line.coalesce(1).write.mode("overwrite").parquet(f"{path}/signatures/batch={name}")
    run.close()
    return status
