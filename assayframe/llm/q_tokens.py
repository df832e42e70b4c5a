"""Queries op6 and op10: token files and packed sequences of the whole documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm.common import table
from assayframe.llm.packing import pack
from assayframe.llm.token_files import read_token_files, write_token_files
from assayframe.llm.tokens import default_path
from assayframe.session import shared_folder


def op6_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token_files_{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, default_path())
    return read_token_files(spark, path)


def op10_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op6_zstd_token_files": op6_zstd_token_files, "op10_packing_dp": op10_packing_dp}
