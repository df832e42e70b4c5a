"""Session settings the plans rely on; all are runtime SQL settings except the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot keys even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # broadcast by sizes measured at run time only: the size of a compressed file, or of rows before
    # they are unrolled, tells little of the table that the driver would have to hold
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB",
    # texts and cells grow several times when unrolled in a task, so tasks are made of smaller parts of a shuffle
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # longer generated methods are never compiled by the JVM; the steps then run as single operators, whose methods are split
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # the files of a shuffle go when the write or action that made it has ended, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names in ``spark.checkpoint.dir``.

    Where none is named, a single-process session (tests, a laptop) uses its
    warehouse folder, which it reads by the same path everywhere; on a cluster
    the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


class Run:
    """Intermediate tables of one run in a folder of their own, removed by ``close``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/assayframe/{uuid.uuid4().hex}"
        self._made = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a table of this run and go on from there.

        The written columns are compressed and pruned on reading, their size is
        known to the optimizer, and losing an executor costs nothing.
        """
        self._made += 1
        path = f"{self.path}/{self._made}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the run's tables; frames read from them are of no use afterwards."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there; see ``Run`` for tables that can go earlier."""
    return Run(df.sparkSession).cut(df)
