"""Queries op1 and op3: quality posteriors and mixing rates of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm.common import table
from assayframe.llm.mixing import copies, mixing_rates
from assayframe.llm.quality import quality_posteriors


def site(docs: DataFrame) -> tuple:
    """Host and path of a document here: its source, and its source and language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def op1_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_posteriors(docs, table(spark, sf_dir, "labels"), *site(docs))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rates.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


QUERIES = {"op1_empirical_bayes": op1_empirical_bayes, "op3_soft_mixing": op3_soft_mixing}
