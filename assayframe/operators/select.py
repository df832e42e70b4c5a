"""Which experiments, suggestions and rows an operator works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import first_rows, lookup
from ..functions.text import nonblank, text
from ..rules import OPEN_SUGGESTIONS


def experiments_once(t: dict[str, DataFrame]) -> DataFrame:
    """Experiments with an id, the first row of each id."""
    return first_rows(t["experiments"].where(nonblank(F.col("experiment_id"))), ["experiment_id"])


def active() -> Column:
    return nonblank(F.col("experiment_id")) & (F.lower(F.trim(text(F.col("status")))) != "abandoned")


def on_date(c: Column, date: str) -> Column:
    return F.trim(text(c)).startswith(date)


def select_experiments(
    t: dict[str, DataFrame], ids: list[str] | DataFrame | None = None, date: str | None = None
) -> DataFrame:
    """``experiment_id`` of the run: the ids asked for, else those of a date, else all not abandoned."""
    exp = t["experiments"]
    if isinstance(ids, DataFrame):
        return ids.select("experiment_id").distinct()
    if ids:
        return exp.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "experiment_id string")
    if not date:
        return exp.where(active()).select("experiment_id").distinct()
    logged = (
        t["daily_log"].where(on_date(F.col("timestamp"), date) & nonblank(F.col("experiment_id")))
        .select("experiment_id").distinct()
    )
    dated = exp.where(active() & on_date(F.col("date"), date)).select("experiment_id")
    touched = exp.where(active()).join(logged, "experiment_id", "left_semi").select("experiment_id")
    return dated.unionByName(touched).distinct()


def is_open() -> Column:
    return F.lower(text(F.col("status"))).isin(OPEN_SUGGESTIONS)


def open_suggestions(t: dict[str, DataFrame]) -> DataFrame:
    """Suggestions that still wait for a decision or a run."""
    return t["suggestions"].where(is_open())


def experiment_status(t: dict[str, DataFrame]) -> DataFrame:
    """Lower-case status per experiment id; the last row of an id wins."""
    e = t["experiments"].where(nonblank(F.col("experiment_id"))).select(
        "row_key", "experiment_id", F.lower(F.trim(text(F.col("status")))).alias("experiment_status"))
    return first_rows(e, ["experiment_id"], last=True).drop("row_key")


def suggestions_with_status(t: dict[str, DataFrame]) -> DataFrame:
    """Open suggestions with the status of the follow-up experiment they propose."""
    status = experiment_status(t).withColumnsRenamed(
        {"experiment_id": "proposed_experiment_id", "experiment_status": "proposed_experiment_status"})
    out = lookup(open_suggestions(t), status, ["proposed_experiment_id"])
    return out.withColumn("proposed_experiment_status", text(F.col("proposed_experiment_status")))


def suggestion_closure(t: dict[str, DataFrame]) -> DataFrame:
    """Status updates of run_planned suggestions whose follow-up is complete."""
    return (
        suggestions_with_status(t)
        .where((F.lower(F.trim("status")) == "run_planned") & nonblank(F.col("suggestion_id"))
               & (F.col("proposed_experiment_status") == "complete"))
        .select("suggestion_id", "proposed_experiment_id", F.lit("status").alias("field"),
                F.lit("run_complete").alias("value"))
    )
