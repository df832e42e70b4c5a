"""Query op12: whitened components of the whole embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm.common import table
from assayframe.llm.whitening import whiten


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    explained = [] if model is None else (model.values / model.trace).tolist()
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


QUERIES = {"op12_bit_sliced_whitening": op12_bit_sliced_whitening}
