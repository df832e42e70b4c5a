"""The contract next to the tables: every contract column with how far it is filled and keeps to its vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..contract import TABLES, contract_rows
from ..functions.text import nonblank


def contract_columns(t: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column, required, allowed_values, rows, filled, outside) for every column of the contract.

    ``outside`` counts filled cells that are none of the column's allowed values.  Each table is read once, with one
    pre-aggregated row of counts, whatever its size.
    """
    out = []
    for name, table in TABLES.items():
        counts = []
        for c in table.columns:
            filled = nonblank(F.col(c))
            wrong = filled & ~F.trim(c).isin(table.vocab[c]) if c in table.vocab else F.lit(False)
            counts.append(F.struct(F.lit(c).alias("column"), F.count(F.when(filled, 1)).alias("filled"), F.count(F.when(wrong, 1)).alias("outside")))
        one = t[name].agg(F.count("*").alias("rows"), F.array(*counts).alias("counts"))
        out.append(one.select(F.lit(table.title).alias("table_name"), "rows", F.inline("counts")))
    spark = next(iter(t.values())).sparkSession
    spec = spark.createDataFrame(contract_rows(), "table_name string, position int, column string, required boolean, allowed_values int")
    return F.broadcast(spec).join(reduce(DataFrame.unionByName, out), ["table_name", "column"])
