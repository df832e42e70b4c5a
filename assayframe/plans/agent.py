"""Agent run: configuration, gates, prediction gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import lookup
from ..functions.metrics import PREDICTION_METRICS, is_emulsion, prediction_metric_key
from ..functions.text import nonblank, present, text
from ..operators.audit import first_config, preflight_checks
from ..operators.literature import confidence_rank
from ..operators.select import experiments_once, is_open
from ..rules import CONFIDENCE, SAFETY_APPROVED, SAFETY_FAILED
from ..texts import GAPS

# ---------------------------------------------------------------------------
# Configuration keys and their types.
# ---------------------------------------------------------------------------
CONFIG_TYPES = {
    "default_context_limit": "nonnegative_int",
    "default_history_limit": "nonnegative_int",
    "default_evidence_limit": "nonnegative_int",
    "default_literature_sources": "string",
    "default_literature_depth": "string",
    "default_literature_limit": "nonnegative_int",
    "suggestion_confidence_floor": "confidence",
    "require_literature_evidence": "bool",
}
DEFAULTS = {"context_limit": 5, "history_limit": 5, "evidence_limit": 3}
MESSAGES = {
    "blank": "Blank Agent Config value was ignored.",
    "nonnegative_int": "Expected a non-negative integer.",
    "confidence": "Expected one of low, medium, or high.",
    "bool": "Expected a boolean value such as true or false.",
}


def parse_config(t: dict[str, DataFrame], types: dict[str, str] = CONFIG_TYPES) -> DataFrame:
    """(key, type, value, parsed, warning) of the known keys; a bad value gives a warning and no parsed value."""
    kind = F.coalesce(*[F.when(F.col("key") == k, F.lit(v)) for k, v in types.items()])
    c = first_config(t).where(F.col("key").isin(list(types))).select("key", kind.alias("type"), F.trim(text(F.col("value"))).alias("value"))
    low = F.lower("value")
    number = F.when(F.col("value").rlike(r"^\+?\d+$"), F.col("value").try_cast("bigint"))
    parsed = (
        F.when(F.col("value") == "", F.lit(None))
        .when(F.col("type") == "string", F.col("value"))
        .when(F.col("type") == "nonnegative_int", number.cast("string"))
        .when(F.col("type") == "confidence", F.when(low.isin(CONFIDENCE), low))
        .when(low.isin("true", "1", "yes", "on"), "true").when(low.isin("false", "0", "no", "off"), "false"))
    c = c.withColumn("parsed", parsed)
    warning = F.when(F.col("value") == "", MESSAGES["blank"]).when(F.col("parsed").isNull(), F.coalesce(
        *[F.when(F.col("type") == k, F.lit(v)) for k, v in MESSAGES.items()]))
    return c.withColumn("warning", text(warning))


def agent_gates(
    selected: DataFrame, t: dict[str, DataFrame], suggestions: DataFrame, evidence: DataFrame,
    confidence_floor: str = "low", require_evidence: bool = False, force: bool = False,
) -> DataFrame:
    """(experiment_id, status, skip_reason, confidence): existing suggestion, then evidence, then confidence floor.

    ``suggestions`` are draft suggestions, ``evidence`` the chosen evidence rows.
    """
    df = selected.select("experiment_id").distinct()
    waiting = t["suggestions"].where(is_open()).groupBy("experiment_id").agg(F.count("*").alias("open_count"))
    chosen = evidence.groupBy("experiment_id").agg(F.count("*").alias("evidence_count"))
    for side in (waiting, chosen, suggestions.select("experiment_id", "confidence")):
        df = lookup(df, side, ["experiment_id"])
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    floor = CONFIDENCE.index(confidence_floor) + 1 if confidence_floor in CONFIDENCE else 1
    reason = (
        F.when((n("open_count") > 0) & F.lit(not force), "existing_suggestion")
        .when((n("evidence_count") == 0) & F.lit(require_evidence), "literature_evidence_required")
        .when(confidence_rank(F.col("confidence")) < floor, "suggestion_confidence_below_floor").otherwise(""))
    return df.select(
        "experiment_id", F.when(reason == "", "ready").otherwise("skipped").alias("status"), reason.alias("skip_reason"),
        text(F.col("confidence")).alias("confidence"), n("evidence_count").alias("evidence_count"))


def gate_summary(gates: DataFrame) -> DataFrame:
    return gates.groupBy("status", "skip_reason").agg(F.count("*").alias("experiments"))


def safety_class(c: Column) -> Column:
    """missing, failed, approved or reminder; failing words are looked for first."""
    low = F.lower(F.trim(text(c)))
    has = lambda terms: reduce(lambda a, b: a | b, [low.contains(x) for x in terms])
    return F.when(low == "", "missing").when(has(SAFETY_FAILED), "failed").when(has(SAFETY_APPROVED), "approved").otherwise("reminder")


def required_metric_gaps(t: dict[str, DataFrame]) -> DataFrame:
    """(experiment_id, present, missing) outcome metrics of emulsion experiments that lack one."""
    key = prediction_metric_key(*[F.col(c) for c in ("measurement_type", "method", "units", "condition")])
    have = t["results"].select(F.trim("experiment_id").alias("experiment_id"), key.alias("k")).groupBy("experiment_id").agg(*[
        F.max((F.col("k") == m).cast("int")).alias(m) for m in PREDICTION_METRICS])
    exp = experiments_once(t).where(is_emulsion(F.col("process_type"))).select("experiment_id")
    df = lookup(exp, have, ["experiment_id"])
    got = lambda m: F.coalesce(F.col(m), F.lit(0)) == 1
    missing = present([(~got(m), F.lit(label)) for m, label in PREDICTION_METRICS.items()])
    return df.where(F.size(missing) > 0).select(
        "experiment_id", F.array_join(present([(got(m), F.lit(m)) for m in sorted(PREDICTION_METRICS)]), ",").alias("present_metrics"),
        F.array_join(missing, ", ").alias("missing_metrics"))


def prediction_gaps(
    t: dict[str, DataFrame], gates: DataFrame, suggestions: DataFrame, new_evidence: DataFrame | None = None,
) -> DataFrame:
    """(experiment_id, code, severity, blocks) of everything a prediction still lacks.

    A suggestion exists for every gated experiment but those skipped for an
    open suggestion or missing evidence.
    """
    g = lookup(gates, suggestions.select("experiment_id", "safety_check", "prior_experiment_count"), ["experiment_id"])
    has = ~F.col("skip_reason").isin("existing_suggestion", "literature_evidence_required")
    g = g.withColumns({"has": has, "safety": safety_class(F.col("safety_check"))})
    rules = [
        ("suggestion_missing", ~F.col("has")),
        ("literature_evidence_missing", F.col("has") & (F.col("evidence_count") == 0)),
        ("safety_check_missing_or_failed", F.col("has") & F.col("safety").isin("missing", "failed")),
        ("safety_review_required", F.col("has") & (F.col("safety") == "reminder")),
        ("historical_benchmarks_missing", F.col("has") & (F.coalesce("prior_experiment_count", F.lit(0)) == 0)),
    ]
    row = lambda code: F.struct(F.lit(code).alias("code"), F.lit(GAPS[code][0]).alias("severity"), F.lit(GAPS[code][1]).alias("blocks"))
    own = g.select("experiment_id", F.inline(F.array_compact(F.array(*[F.when(cond, row(code)) for code, cond in rules]))))
    metric = lookup(required_metric_gaps(t), g.where("has").select("experiment_id"), ["experiment_id"], "left_semi").select(
        "experiment_id", F.inline(F.array(row("result_metrics_missing"))))
    checks = preflight_checks(t, "review", g.select("experiment_id")).where(F.col("status") != "pass")
    checks = lookup(checks, g.select("experiment_id", "evidence_count", "skip_reason"), ["experiment_id"])
    # the literature check is settled by evidence the run selected itself
    settled = (F.col("check") == "literature_evidence") & (F.col("evidence_count") > 0) & (F.col("skip_reason") != "existing_suggestion")
    checks = checks.where(~settled).select(
        "experiment_id", F.concat("check", F.lit("_missing")).alias("code"),
        F.when(F.col("status") == "warn", "warning").otherwise("error").alias("severity"),
        F.when(F.col("status") == "fail", "execution").otherwise("review").alias("blocks"))
    parts = [own, metric, checks]
    if new_evidence is not None:
        fresh = lookup(new_evidence.select("experiment_id").distinct(), g.select("experiment_id"), ["experiment_id"], "left_semi")
        parts.append(fresh.select("experiment_id", F.inline(F.array(row("literature_evidence_unreviewed")))))
    return reduce(DataFrame.unionByName, parts).distinct()


def prediction_status(gates: DataFrame, gaps: DataFrame) -> DataFrame:
    """(experiment_id, prediction_status, gap and blocker counts)."""
    n = gaps.groupBy("experiment_id").agg(
        F.count("*").alias("gaps"), F.count(F.when(F.col("blocks") == "prediction", 1)).alias("blockers"))
    df = lookup(gates, n, ["experiment_id"])
    c = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint")
    status = (
        F.when((F.col("status") != "ready") | (c("blockers") > 0), "blocked")
        .when(c("gaps") > 0, "predicted_with_gaps").otherwise("predicted"))
    return df.select("experiment_id", status.alias("prediction_status"), c("gaps").alias("gap_count"), c("blockers").alias("blocker_count"))


def prediction_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("prediction_status").agg(
        F.count("*").alias("predictions"), F.sum("gap_count").cast("bigint").alias("gap_count"),
        F.sum("blocker_count").cast("bigint").alias("blocker_count"))
