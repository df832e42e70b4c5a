"""Audits of the notebook before a run: material roles, required cells, vocabularies, preflight checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..contract import ROW_KEY, TABLES
from ..functions.joins import lookup
from ..functions.metrics import is_emulsion
from ..functions.text import any_of, nonblank, present, split_list, text
from ..rules import (
    CHECKS, MATERIAL_ADVICE, MISSING_ROW_ACTION, PREFLIGHT_READY, QUANTITY_FIELDS, REQUIRED_GROUPS, ROLE_GROUPS,
)
from .formulation import enrich
from .select import experiments_once, is_open


def in_group(group: str) -> Column:
    roles = ROLE_GROUPS[group]["roles"]
    return F.lower(text(F.col("target_role"))).isin(roles) | F.lower(text(F.col("reagent_category"))).isin(roles)


def missing_properties() -> Column:
    """Reagent fields the target role needs and neither the row nor the reagent has, sorted by name."""
    role = F.lower(text(F.col("target_role")))
    out = []
    for field in sorted({f for s in ROLE_GROUPS.values() for f in s["fields"]}):
        roles = [r for s in ROLE_GROUPS.values() if field in s["fields"] for r in s["roles"]]
        has = nonblank(F.col(f"reagent_{field}"))
        if field in TABLES["formulations"].columns:
            has = has | nonblank(F.col(field))
        out.append((role.isin(roles) & ~has, F.lit(field)))
    return present(out)


def is_placeholder() -> Column:
    t = F.lower(F.concat_ws(" ", *[text(F.col(c)) for c in (
        "reagent_id", "reagent_name", "reagent_common_name", "reagent_notes", "notes")]))
    return t.contains("todo") | t.contains("starter placeholder") | text(F.col("reagent_id")).startswith("AUTO-")


def role_coverage(t: dict[str, DataFrame]) -> DataFrame:
    """Present or missing per (emulsion experiment, role group).

    One flag per group in a single pre-aggregated pass over the formulations;
    the five groups are unrolled from columns, so there is no cross join.
    """
    flags = enrich(t["formulations"], t["reagents"]).groupBy("experiment_id").agg(
        *[F.sum(in_group(g).cast("int")).alias(g) for g in ROLE_GROUPS])
    exp = experiments_once(t).where(is_emulsion(F.col("process_type"))).select("experiment_id")
    df = lookup(exp, flags, ["experiment_id"])
    cells = F.array(*[
        F.struct(F.lit(g).alias("role_group"), F.lit(s["required"]).alias("required"),
                 F.coalesce(F.col(g), F.lit(0)).cast("bigint").alias("rows"))
        for g, s in ROLE_GROUPS.items()])
    return df.select("experiment_id", F.inline(cells)).withColumn(
        "status", F.when(F.col("rows") > 0, "present").otherwise("missing"))


def material_flags(t: dict[str, DataFrame]) -> DataFrame:
    """All formulation-based audit counts per experiment in one pass."""
    quantity_gap = ~any_of([nonblank(F.col(f)) for f in QUANTITY_FIELDS])
    has_id = nonblank(F.col("reagent_id"))
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    return enrich(t["formulations"], t["reagents"]).groupBy("experiment_id").agg(
        *[n(in_group(g)).alias(f"has_{g}") for g in REQUIRED_GROUPS],
        F.count("*").alias("formulation_rows"),
        n(quantity_gap).alias("quantity_gaps"),
        n(F.size(missing_properties()) > 0).alias("property_gaps"),
        n(has_id & ~nonblank(F.col("reagent_hazards"))).alias("safety_gaps"),
        n(is_placeholder()).alias("placeholders"),
    )


def material_audit(t: dict[str, DataFrame]) -> DataFrame:
    """Missing role groups, gap counts, readiness, advice and summary per experiment."""
    df = lookup(experiments_once(t), material_flags(t), ["experiment_id"])
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    emulsion = is_emulsion(F.col("process_type"))
    df = df.withColumns({
        "missing_required": F.when(emulsion, present([(n(f"has_{g}") == 0, F.lit(g)) for g in REQUIRED_GROUPS]))
        .otherwise(F.array().cast("array<string>")),
        "quantity_gaps": n("quantity_gaps"),
        "property_gaps": F.when(emulsion, n("property_gaps")).otherwise(F.lit(0).cast("bigint")),
        "safety_gaps": n("safety_gaps"),
        "placeholders": n("placeholders"),
    })
    groups = F.array_join("missing_required", ", ")
    no_roles, no_qty, no_prop = (F.size("missing_required") > 0, F.col("quantity_gaps") > 0, F.col("property_gaps") > 0)
    advice = present([
        (no_roles, F.concat(F.lit(MATERIAL_ADVICE["roles"]), groups, F.lit("."))),
        (no_qty, F.lit(MATERIAL_ADVICE["quantities"])),
        (no_prop, F.lit(MATERIAL_ADVICE["properties"])),
    ])
    parts = present([
        (no_roles, F.concat(F.lit("missing required groups: "), groups)),
        (no_qty, F.concat(F.col("quantity_gaps").cast("string"), F.lit(" formulation rows lack quantitative basis"))),
        (no_prop, F.concat(F.col("property_gaps").cast("string"), F.lit(" formulation rows have reagent property gaps"))),
    ])
    ready = ~no_roles & ~no_qty & ~no_prop
    return df.select(
        "experiment_id", "process_type", "missing_required", "quantity_gaps", "property_gaps",
        "safety_gaps", "placeholders", ready.alias("ready"),
        F.when(ready, F.array(F.lit(MATERIAL_ADVICE["ok"]))).otherwise(advice).alias("recommendations"),
        F.when(ready, F.lit(MATERIAL_ADVICE["summary_ok"])).otherwise(
            F.concat(F.lit(MATERIAL_ADVICE["summary"]), F.array_join(parts, "; "), F.lit("."))).alias("summary"),
    )


def required_violations(t: dict[str, DataFrame]) -> DataFrame:
    """Rows with blank required cells, all tables."""
    out = None
    for name, table in TABLES.items():
        if not table.required or name not in t:
            continue
        df = t[name].select(
            F.lit(table.title).alias("table_name"), ROW_KEY,
            F.col(table.required[0]).alias("record"),
            F.array_join(present([(~nonblank(F.col(c)), F.lit(c)) for c in table.required]), ",").alias("missing_fields"),
        ).where(F.col("missing_fields") != "")
        out = df if out is None else out.unionByName(df)
    return out


def vocab_violations(t: dict[str, DataFrame]) -> DataFrame:
    """Nonblank cells outside their controlled vocabulary.

    The vocabularies are fixed lists of the contract, so they are folded into
    the scan as ``IN`` filters instead of a join.
    """
    out = None
    for name, table in TABLES.items():
        for field, values in table.vocab.items():
            df = t[name].where(nonblank(F.col(field)) & ~F.trim(field).isin(values)).select(
                F.lit(table.title).alias("table_name"), ROW_KEY, F.lit(field).alias("field"), F.col(field).alias("value"))
            out = df if out is None else out.unionByName(df)
    return out


def first_config(t: dict[str, DataFrame]) -> DataFrame:
    """First value of every configuration key."""
    c = t["config"].where(nonblank(F.col("key")))
    return c.groupBy(F.trim("key").alias("key")).agg(F.min_by("value", ROW_KEY).alias("value"))


def safety_required(t: dict[str, DataFrame]) -> DataFrame:
    """One row: does a missing hazard note fail (true) or warn (false)?"""
    off = F.lower(F.trim("value")).isin("false", "0", "no", "off")
    return first_config(t).where(F.col("key") == "safety_review_required").agg(
        F.coalesce(F.max(~off), F.lit(True)).alias("safety_required"))


def linked_evidence_counts(t: dict[str, DataFrame]) -> DataFrame:
    """Evidence rows named in an experiment's linked list (comma separated, as the entry reads it)."""
    links = experiments_once(t).select(
        "experiment_id", F.explode(F.array_distinct(split_list(F.col("linked_literature_ids"), semicolons=False))).alias("evidence_id"))
    rows = t["evidence"].groupBy("evidence_id").agg(F.count("*").alias("n"))
    return lookup(links, rows, ["evidence_id"], "inner").groupBy("experiment_id").agg(
        F.sum("n").cast("bigint").alias("evidence_count"))


def preflight_base(t: dict[str, DataFrame], selected: DataFrame | None = None) -> DataFrame:
    """Counts every check needs, one row per experiment; ids without a row stay with ``known`` false."""
    exp = experiments_once(t)
    audit = material_audit(t).drop("process_type", "recommendations", "summary")
    obs = t["daily_log"].groupBy("experiment_id").agg(F.count("*").alias("observation_count"))
    res = t["results"].groupBy("experiment_id").agg(F.count("*").alias("result_count"))
    sug = t["suggestions"].where(is_open()).groupBy("experiment_id").agg(F.count("*").alias("open_count"))
    df = exp.withColumn("known", F.lit(True))
    for side in (audit, obs, res, linked_evidence_counts(t), sug):
        df = lookup(df, side, ["experiment_id"])
    if selected is not None:
        df = lookup(selected.select("experiment_id").distinct(), df, ["experiment_id"])
    df = df.crossJoin(F.broadcast(safety_required(t)))  # one row by construction
    return df.withColumn("known", F.coalesce("known", F.lit(False)))


def preflight_checks(
    t: dict[str, DataFrame], stage: str = "planning", selected: DataFrame | None = None
) -> DataFrame:
    """(experiment, check, status, message, action) for the ten checks of a stage."""
    if stage not in ("planning", "review"):
        raise ValueError("stage must be planning or review")
    df = preflight_base(t, selected)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    req = TABLES["experiments"].required
    blanks = present([(~nonblank(F.col(f)), F.lit(f)) for f in ("experiment_id", "date", "process_type", "objective", "status")])
    assert set(req) == {"experiment_id", "date", "process_type", "objective", "status"}
    soft = "fail" if stage == "review" else "warn"
    missing = F.array_join("missing_required", ", ")
    rules = [
        ("experiment_required_fields", F.size(blanks) > 0, F.lit("fail"),
         F.transform(blanks, lambda f: F.concat(F.lit("Fill Experiments."), f, F.lit(".")))),
        ("material_roles", F.size("missing_required") > 0, F.lit("fail"),
         F.array(F.concat(F.lit(CHECKS["material_roles"][2]), missing, F.lit(".")))),
        ("formulation_quantities", n("quantity_gaps") > 0, F.lit("fail"), None),
        ("reagent_properties", n("property_gaps") > 0, F.lit("fail"), None),
        ("reagent_safety", n("safety_gaps") > 0, F.when(F.col("safety_required"), "fail").otherwise("warn"), None),
        ("placeholder_reagents", n("placeholders") > 0, F.lit("fail"), None),
        ("daily_log_observations", n("observation_count") == 0, F.lit(soft), None),
        ("results_measurements", n("result_count") == 0, F.lit(soft), None),
        ("literature_evidence", n("evidence_count") == 0, F.lit("warn"), None),
        ("open_suggestions", n("open_count") > 0, F.lit("warn"), None),
    ]
    none = F.array().cast("array<string>")
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("check_pos"), F.lit(name).alias("check"),
            F.when(bad, status).otherwise("pass").alias("status"),
            F.when(bad, CHECKS[name][1]).otherwise(CHECKS[name][0]).alias("message"),
            F.when(bad, actions if actions is not None else F.array(F.lit(CHECKS[name][2]))).otherwise(none).alias("actions"),
        )
        for i, (name, bad, status, actions) in enumerate(rules)
    ])
    absent = F.array(F.struct(
        F.lit(0).alias("check_pos"), F.lit("experiment_row").alias("check"), F.lit("fail").alias("status"),
        F.concat(F.lit("Experiment '"), "experiment_id", F.lit("' was not found in Experiments.")).alias("message"),
        F.array(F.lit(MISSING_ROW_ACTION)).alias("actions"),
    ))
    return df.select("experiment_id", F.inline(F.when(F.col("known"), cells).otherwise(absent)))


def preflight_summary(
    t: dict[str, DataFrame], stage: str = "planning", selected: DataFrame | None = None
) -> DataFrame:
    """Check counts, status, readiness and the distinct actions in check order."""
    c = preflight_checks(t, stage, selected)
    count = lambda s: F.sum((F.col("status") == s).cast("int")).cast("bigint")
    passed = lambda name: F.max(((F.col("check") == name) & (F.col("status") == "pass")).cast("int")) == 1
    df = c.groupBy("experiment_id").agg(
        F.count("*").alias("check_count"), count("pass").alias("pass_count"), count("warn").alias("warn_count"),
        count("fail").alias("fail_count"), F.sum(F.size("actions")).cast("bigint").alias("action_count"),
        passed("daily_log_observations").alias("has_log"), passed("results_measurements").alias("has_results"),
        # at most ten checks per experiment
        F.array_sort(F.collect_list(F.struct("check_pos", "actions"))).alias("acts"),
    )
    acts = F.array_distinct(F.flatten(F.transform("acts", lambda x: x["actions"])))
    ready = F.col("fail_count") == 0
    has_data = F.col("has_log") & F.col("has_results")
    return df.select(
        "experiment_id", "check_count", "pass_count", "warn_count", "fail_count", "action_count",
        F.when(~ready, "needs_attention").when(F.col("warn_count") > 0, "ready_with_warnings").otherwise("ready").alias("status"),
        ready.alias("ready_to_run"),
        (ready & has_data if stage == "review" else ready).alias("ready_for_agent_suggestion"),
        F.when(F.size(acts) == 0, F.array(F.lit(PREFLIGHT_READY))).otherwise(acts).alias("next_actions"),
    )
