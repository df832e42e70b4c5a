"""Join and grouping helpers that stay whole under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..contract import ROW_KEY


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a fact side to a side with at most one row per key.

    ``right`` usually comes out of a ``groupBy`` on the same keys.  Adaptive
    execution only splits a hot key of ``left`` when both inputs of the
    sort-merge join are plain shuffles, so ``right`` joins on a derived copy of
    its keys: Spark then shuffles it afresh (it is small) and the hot key is
    split at run time.  Where ``right`` proves small, Spark broadcasts it by
    its measured size.
    """
    names = {k: f"__r_{k}" for k in keys}
    copy = lambda k: (F.concat(F.col(k), F.lit("")) if right.schema[k].dataType == T.StringType()
                      else F.col(k) + F.lit(0))
    r = right.select(
        *[copy(k).alias(names[k]) for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = [left[k] == r[names[k]] for k in keys]
    return left.join(r, cond, how).drop(*names.values())


def first_rows(df: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``row_key``; partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != ROW_KEY]
    pick = F.max_by if last else F.min_by
    at = F.max if last else F.min
    return (
        df.groupBy(*keys)
        .agg(at(ROW_KEY).alias(ROW_KEY), pick(F.struct(*rest), F.col(ROW_KEY)).alias("__row"))
        .select(ROW_KEY, *keys, "__row.*")
        .select(*df.columns)
    )


def first_by(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
