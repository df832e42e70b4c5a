"""Corpus pipeline over the documents table: quality, near-duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir); ``docs`` are the rows its predecessor kept, and all but the last return the
columns of documents.  Rows without doc_id leave at the second stage, whose groups are named by ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm.common import table
from assayframe.llm.mixing import copies, mixing_rates
from assayframe.llm.near_copies import near_copies
from assayframe.llm.packing import pack
from assayframe.llm.passages import without_repeats
from assayframe.llm.q_corpus import site
from assayframe.llm.quality import quality_posteriors
from assayframe.llm.simhash import simhash_components
from assayframe.llm.tokens import default_path
from assayframe.session import Run, cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality_posteriors(docs, table(spark, sf_dir, "labels"), *site(docs))
    rejected = cut(judged.where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies the smallest id stays.

    Groups are those of SimHash over pivot distance tables, joined by near copies further apart than its bits tell
    (five-word shingles, Jaccard similarity 0.8 or more).
    """
    copies_found = cut(simhash_components(docs).select("doc_id", "component_id").distinct())
    found = near_copies(docs, copies_found)
    others = cut(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return docs.where(F.col("doc_id").isNotNull()).join(others, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier too are cut out of the texts."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are kept in proportion to their rates; those surely of the clean domain all stay."""
    rates = mixing_rates(docs, table(spark, sf_dir, "labels"))
    share = F.when(F.col("top_rate") > 0, F.least(F.lit(1.0), F.col("rate") / F.col("top_rate"))).otherwise(F.lit(1.0))
    near = F.when(F.col("p_clean") >= 0.5, F.lit(1.0)).otherwise(share)
    left = cut(rates.where(copies(near, F.col("doc_id")) == 0).select("doc_id").distinct())
    return docs.join(left, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 tokens, one row for each piece of a document."""
    return pack(docs, default_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixing", mixing), ("packing", packing)]
#: The stages learn from labels, follow links and use a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables = Run(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = tables.cut(docs)
    return docs
