"""Query op4: near-duplicate vectors of the whole embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm.common import table
from assayframe.llm.lattice import lattice_links


def op4_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_links(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


QUERIES = {"op4_e8_lattice": op4_e8_lattice}
