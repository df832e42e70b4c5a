"""Connected components of a link table, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.session import Run, cut


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them.

    ``links`` has rows (u, v) with u > v.  ``both``: of each node all neighbours
    are seen and the larger ones moved (large star), else only smaller ones are
    seen and all moved, the node too (small star).
    """
    seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else links
    low = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")) if both else links.groupBy("u").agg(F.min("v").alias("low"))
    hung = seen.where(F.col("v") > F.col("u")) if both else seen
    moved = hung.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    if not both:
        moved = moved.unionByName(low.select("u", F.col("low").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, tables: Run | None = None) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in a link.

    ``links``: two long columns ``a`` and ``b``; self links, nulls and repeats are
    ignored.  Each round pre-aggregates minima and joins them back, so a node
    with very many links is no single task's work; the rounds' tables are
    written to the shared folder, as tables of the caller's run if it gives one.  Ends
    when a round changes nothing.
    """
    write = cut if tables is None else tables.cut
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = write(pairs.where(F.col("u") > F.col("v")).distinct())
    mark = None
    while True:
        row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or mark == (row["n"], row["h"]):
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("id"), F.col("v").alias("component"))
            ).distinct()
        mark = (row["n"], row["h"])
        pairs = write(_stars(_stars(pairs, True), False))
