"""Outcome analysis: measurements against targets, signals, guidance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..contract import ROW_KEY, TABLES
from ..functions.joins import first_rows, lookup
from ..functions.metrics import (
    TARGETS, is_emulsion, log_row_flags, metric_key, qualitative_signals, raised, result_row_flags,
    targets_df, text_flags, text_signals,
)
from ..functions.text import fmt6, key_values, nonblank, num_strict, num_token, present, text
from ..rules import IN_TARGET, LOG_FIELDS, METRIC_LOG_FIELDS, NO_MEASUREMENTS, NO_TARGETS, QUALITATIVE_COAGULUM
from .select import experiments_once


def measurements(t: dict[str, DataFrame]) -> DataFrame:
    """Numeric outcomes of Results and of the structured log cells."""
    res = t["results"].select(
        "experiment_id", F.lit(0).alias("source_pos"), ROW_KEY, F.lit(0).alias("field_pos"),
        F.lit("Results").alias("source"),
        metric_key(F.col("measurement_type"), F.col("units")).alias("metric_key"),
        "measurement_type", "sample_id", num_token(F.col("value")).alias("value"), text(F.col("units")).alias("units"),
        "condition", "quality_flag",
    )
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("field_pos"),
            metric_key(F.lit(LOG_FIELDS[f][0]), F.lit(LOG_FIELDS[f][1])).alias("metric_key"),
            F.lit(LOG_FIELDS[f][0]).alias("measurement_type"),
            num_token(F.col(f)).alias("value"), F.lit(LOG_FIELDS[f][1]).alias("units"),
        )
        for i, f in enumerate(METRIC_LOG_FIELDS)
    ])
    log = t["daily_log"].select(
        "experiment_id", F.lit(1).alias("source_pos"), ROW_KEY, F.lit("Daily Log").alias("source"),
        F.lit("").alias("sample_id"), F.col("timestamp").alias("condition"),
        F.lit("observed").alias("quality_flag"), F.inline(cells),
    )
    return res.unionByName(log).where(F.col("value").isNotNull() & (F.col("metric_key") != ""))


def measurement_dedupe(t: dict[str, DataFrame]) -> DataFrame:
    """First row of each (experiment, metric, value, units); Results before Daily Log."""
    keys = ["experiment_id", "metric_key", "value", "units"]
    at = F.struct("source_pos", ROW_KEY, "field_pos")
    rest = F.struct("source", "measurement_type", "sample_id", "condition", "quality_flag")
    return (
        measurements(t).groupBy(*keys)
        .agg(F.min(at).alias("at"), F.min_by(rest, at).alias("row"))
        .select(*keys, "at.*", "row.*")
    )


def evaluate(df: DataFrame) -> DataFrame:
    """Compare measurements with the targets; the five targets are a fixed broadcast side."""
    df = df.join(F.broadcast(targets_df(df.sparkSession)), "metric_key", "left")
    low = F.col("value") < F.col("target_min")
    high = F.col("value") > F.col("target_max")
    has = F.col("target_label").isNotNull() & F.col("emulsion")
    status = (
        F.when(~has, "no_target")
        .when(low, "below_target").when(high, "above_target").otherwise("in_target")
    )
    df = df.withColumn("status", status)
    off = F.col("status").isin("below_target", "above_target")
    return df.withColumns({
        "priority": F.when(off, F.col("target_priority")).otherwise(99),
        "guidance": F.when(F.col("status") == "below_target", F.col("guidance_low"))
        .when(F.col("status") == "above_target", F.col("guidance_high")).otherwise(""),
        "signals": F.when(F.col("status") == "below_target", F.col("signals_low"))
        .when(F.col("status") == "above_target", F.col("signals_high"))
        .otherwise(F.array().cast("array<string>")),
    }).drop("target_priority", "guidance_low", "guidance_high", "signals_low", "signals_high")


def target_evaluation(t: dict[str, DataFrame]) -> DataFrame:
    """Every distinct measurement with its target status, priority, guidance and signals."""
    exp = experiments_once(t).select("experiment_id", is_emulsion(F.col("process_type")).alias("emulsion"))
    return evaluate(lookup(measurement_dedupe(t), exp, ["experiment_id"], "inner"))


def limiting_metrics(evaluated: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` off-target measurements per experiment by priority and metric."""
    w = Window.partitionBy("experiment_id").orderBy(
        "priority", "metric_key", "source_pos", ROW_KEY, "field_pos")
    return (
        evaluated.where(F.col("status").isin("below_target", "above_target"))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    )


def qualitative(t: dict[str, DataFrame]) -> DataFrame:
    """Signals the log text raises, one row per (experiment, signal)."""
    return (
        t["daily_log"]
        .select("experiment_id", F.explode(qualitative_signals(F.col("observation"), F.col("issue_tags"))).alias("signal"))
        .distinct()
    )


def row_text(table: str):
    """``column value`` text of a row, column names included."""
    return key_values([(c, c) for c in TABLES[table].columns])


def entry_signals(t: dict[str, DataFrame]) -> DataFrame:
    """Signals read directly from the rows of an experiment, one row per (experiment, signal)."""
    exp, log, res, frm = (t[n] for n in ("experiments", "daily_log", "results", "formulations"))
    exp_text = F.concat_ws(" ", "process_type", "objective", "hypothesis")
    # only reagents whose own text raises a signal take part in the join
    loud = (
        first_rows(t["reagents"].where(nonblank(F.col("reagent_id"))), ["reagent_id"], last=True)
        .select("reagent_id", text_signals(row_text("reagents")).alias("signals"))
        .where(F.size("signals") > 0)
    )
    # the text of a row is put together and lower-cased once, in a projection of its own
    lowered = lambda df, c, *more: df.select("experiment_id", F.lower(c).alias("low"), *more)
    in_text = text_flags(F.col("low"))
    log_flags = log_row_flags(F.col("issue_tags"), F.col("particle_size_nm"), F.col("conversion_percent"))
    measured = [F.lower(text(F.col("measurement_type"))).alias("kind"), num_strict(F.col("value")).alias("number")]
    parts = [
        raised(lowered(exp, exp_text), in_text),
        raised(lowered(log, row_text("daily_log"), "issue_tags", "particle_size_nm", "conversion_percent"), F.concat(in_text, log_flags)),
        raised(lowered(res, row_text("results"), *measured), F.concat(in_text, result_row_flags(F.col("kind"), F.col("number")))),
        raised(lowered(frm, row_text("formulations")), in_text),
        lookup(frm.select("experiment_id", "reagent_id"), loud, ["reagent_id"], "inner")
        .select("experiment_id", F.explode("signals").alias("signal")),
    ]
    known = experiments_once(t).select("experiment_id")
    return lookup(reduce(DataFrame.unionByName, parts).distinct(), known, ["experiment_id"], "left_semi")


def experiment_signals(t: dict[str, DataFrame]) -> DataFrame:
    """All signals of each experiment: read from rows, from log text, and from target limits."""
    known = experiments_once(t).select("experiment_id")
    found = qualitative(t).unionByName(
        target_evaluation(t).select("experiment_id", F.explode("signals").alias("signal")))
    found = lookup(found.distinct(), known, ["experiment_id"], "left_semi")
    return entry_signals(t).unionByName(found).distinct()


def result_analysis(t: dict[str, DataFrame]) -> DataFrame:
    """One row per experiment: counts, analysis signals, guidance and summary text.

    Lists stay bounded: signals and guidance come from the fixed rule sets, and
    the summary names three measurements.
    """
    exp = experiments_once(t).select(
        "experiment_id", "process_type", is_emulsion(F.col("process_type")).alias("emulsion"))
    ev = target_evaluation(t)
    off = F.col("status").isin("below_target", "above_target")
    flags = {f"{m}_{side}": F.max(F.when((F.col("metric_key") == m) & (F.col("status") == f"{side}_target"), 1))
             for m in TARGETS for side in ("below", "above")}
    counts = ev.groupBy("experiment_id").agg(
        F.count("*").alias("measurement_count"), F.count(F.when(off, 1)).alias("limiting_count"),
        *[v.alias(k) for k, v in flags.items()],
        *[F.min(F.when((F.col("metric_key") == "particle_size") & (F.col("status") == s),
                       F.struct("source_pos", ROW_KEY, "field_pos"))).alias(s)
          for s in ("below_target", "above_target")],
    )
    piece = F.concat(F.rtrim(F.concat_ws(" ", "metric_key", fmt6(F.col("value")), "units")), F.lit(" is "), "status")
    top = limiting_metrics(ev).groupBy("experiment_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))).alias("top"))
    qual = qualitative(t).groupBy("experiment_id").agg(F.array_sort(F.collect_set("signal")).alias("qualitative"))
    df = exp
    for side in (counts, top, qual):
        df = lookup(df, side, ["experiment_id"])
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.array().cast("array<string>")
    quals = F.coalesce("qualitative", none)
    # guidance follows (priority, metric) order; metrics of equal priority sort by name
    order = sorted(TARGETS, key=lambda m: (TARGETS[m][4], m))
    advice = lambda m, side: (F.col(f"{m}_{side}") == 1, F.lit(TARGETS[m][5 if side == "below" else 6]))
    by_order = lambda sides: present([advice(m, s) for m in order for s in sides if TARGETS[m][5 if s == "below" else 6]])
    # a metric with two limits lists first the side that was measured first
    guidance = F.when(F.col("above_target") < F.col("below_target"), by_order(("above", "below"))).otherwise(
        by_order(("below", "above")))
    measured = present([
        (F.col(f"{m}_{side}") == 1, F.lit(s))
        for m in TARGETS for side, at in (("below", 7), ("above", 8)) for s in TARGETS[m][at]
    ])
    stability = F.coalesce(F.col("coagulum_mass_above") == 1, F.lit(False))
    guidance = F.concat(guidance, F.when(
        F.array_contains(quals, "coagulum") & ~stability, F.array(F.lit(QUALITATIVE_COAGULUM))).otherwise(none))
    guidance = (
        F.when(n("measurement_count") == 0, F.array(F.lit(NO_MEASUREMENTS)))
        .when(~F.col("emulsion"), F.array(F.lit(NO_TARGETS)))
        .when(F.size(guidance) == 0, F.array(F.lit(IN_TARGET)))
        .otherwise(guidance)
    )
    limits = F.array_join(F.transform(F.col("top"), lambda x: x["p"]), "; ")
    summary = (
        F.when(n("measurement_count") == 0,
               F.lit("No numeric Results or structured Daily Log measurements were available for target comparison."))
        .when(n("limiting_count") > 0, F.concat(F.lit("Outcome limits: "), limits, F.lit(".")))
        .when(F.size(quals) > 0, F.concat(
            F.lit("Numeric measurements were in target where targets exist, but qualitative signals remain: "),
            F.array_join(quals, ", "), F.lit(".")))
        .otherwise(F.lit("Numeric measurements are within the first-pass target profile where targets exist."))
    )
    return df.select(
        "experiment_id", "process_type",
        F.when(F.col("emulsion"), "emulsion polymerization").otherwise("").alias("target_profile"),
        n("measurement_count").cast("bigint").alias("measurement_count"),
        n("limiting_count").cast("bigint").alias("limiting_count"),
        F.array_sort(F.array_union(measured, quals)).alias("signals"),
        guidance.alias("guidance"), summary.alias("summary"),
    )


def current_metrics(t: dict[str, DataFrame]) -> DataFrame:
    """First numeric value per (experiment, metric) in Results; the whole cell must be a number."""
    r = t["results"].select(
        "experiment_id", ROW_KEY, metric_key(F.col("measurement_type"), F.col("units")).alias("metric_key"),
        num_strict(F.col("value")).alias("value"))
    return (
        r.where(F.col("value").isNotNull() & (F.col("metric_key") != ""))
        .groupBy("experiment_id", "metric_key").agg(F.min_by("value", ROW_KEY).alias("value"))
    )
