"""Query op13: fingerprints of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm.common import table
from assayframe.llm.winnowing import edited_fingerprints


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op13_winnowing": op13_winnowing}
