"""Query op9: language-model scores of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm.common import table
from assayframe.llm.lattice_lm import default_vocabulary, score_documents


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op9_lattice_lm": op9_lattice_lm}
