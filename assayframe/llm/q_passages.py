"""Query op7: repeated passages removed from the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm.common import table
from assayframe.llm.passages import digest, remove_repeats


def op7_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents")))


QUERIES = {"op7_bucket_refinement": op7_bucket_refinement}
