"""The notebook as a stream: continuous log normalisation, by batch or by day, and day counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..contract import ROW_KEY, TABLES
from ..operators.log_results import SAMPLE_KEY, log_cells
from ..sources.tables import clean
from . import store


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 100) -> DataFrame:
    """Daily log rows arriving as Parquet files; None takes all files there are in one micro-batch."""
    reader = spark.readStream.schema(TABLES["daily_log"].schema())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return clean(reader.parquet(path), "daily_log")


def timed(log: DataFrame) -> DataFrame:
    """Rows with their event time ``ts``; null where the cell is no time."""
    return log.withColumn("ts", F.col("timestamp").try_cast("timestamp"))


def day_counts(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Observations per calendar day of the row time, in append mode: a day appears once, when the watermark has passed it.

    Rows that come later than ``delay`` are not counted; ``late_rows`` finds them.
    """
    days = timed(log).where(F.col("ts").isNotNull()).withWatermark("ts", delay).groupBy(F.window("ts", "1 day"))
    return days.agg(F.count("*").alias("observations")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "observations")


def late_rows(log: DataFrame, published: DataFrame) -> DataFrame:
    """The side output of the day counts: (day, observations, counted) of the days whose count lacks rows.

    ``log`` is the whole log as a table, ``published`` the days that the stream has written; days it has not written
    yet are left out, so what is returned is what the batch run has to add.  Rows without a time belong to no day.
    """
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    whole = timed(log).where(F.col("ts").isNotNull()).groupBy(day).agg(F.count("*").alias("observations"))
    counted = published.select("day", F.col("observations").alias("counted"))
    return whole.join(counted, "day").where("observations > counted")


def watch_results(log: DataFrame, path: str, checkpoint: str, continuous: str | None = None, base: DataFrame | None = None) -> StreamingQuery:
    """Publish the result rows of every micro-batch to the store at ``path``.

    Rows that are stored already, an identical batch and a replayed one add nothing; ``base`` are results that exist
    elsewhere.  Two watches may share a store only one after the other.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store.publish(batch, path, store.batch_name(checkpoint, batch_id), base)

    writer = log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def first_candidates(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cells of a streamed log by the day of their time, each pair of keys once a day, in append mode.

    The state holds one row for each (day, sample key, value key), the smallest by row key and field, and lets it go
    when the watermark has passed the day: a row whose two keys both stood earlier is dropped by any reader, whichever
    rows that reader has kept.  Micro-batches send one partial row a task and pair, so a hot experiment or a cell that is
    repeated without end does not gather in one task.  Rows later than ``delay`` and rows without a time are left out.
    """
    rows = log_cells(timed(log).where(F.col("ts").isNotNull()).withWatermark("ts", delay), ("ts",))
    keys = [*SAMPLE_KEY, "vk_value"]
    first = rows.groupBy(F.window("ts", "1 day"), *keys).agg(F.min(F.struct(ROW_KEY, "field_pos", "value", "condition")).alias("first"))
    return first.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *keys, "first.*")


def watch_days(
    log: DataFrame, path: str, checkpoint: str, delay: str = "1 day", continuous: str | None = None, base: DataFrame | None = None
) -> StreamingQuery:
    """Publish the result rows of every day that the watermark has passed, in the order day, row key, field.

    Days are published in their order and a day once, so rows that come in any order within ``delay`` give the same
    store.  ``publish_rest`` adds late rows and rows without a time.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store.publish_candidates(batch, path, store.batch_name(checkpoint, batch_id), base, ("day", ROW_KEY, "field_pos"))

    writer = first_candidates(log, delay).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def publish_rest(log: DataFrame, path: str, name: str, base: DataFrame | None = None) -> str:
    """The batch run after ``watch_days``: rows of the whole log (a table) that neither key of a stored row matches."""
    return store.publish(log, path, name, base)


def watch_summary(spark: SparkSession, path: str) -> DataFrame:
    """Counters of a store: batches, batches that appended, identical ones, rows appended."""
    s = store.signatures(spark, path)
    return s.agg(
        F.count("*").alias("batches"), F.count(F.when(F.col("appended") > 0, 1)).alias("applied_batches"),
        F.count(F.when(F.col("status") == "identical", 1)).alias("identical_batches"), F.coalesce(F.sum("appended"), F.lit(0)).alias("rows"))
