"""Query op2: quality rules over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm.common import table
from assayframe.llm.rules import judge


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op2_divergence_rules": op2_divergence_rules}
