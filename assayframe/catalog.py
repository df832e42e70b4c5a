"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .adapters import notebook, works
from .functions import metrics, text, units
from .functions.joins import lookup
from .operators import audit, formulation, history, log_results, results, select
from .session import cut, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LOG_DATE = "2024-01-05"
EXP_DATE = "1997-03"


def register(fn):
    """Register a function of the notebook tables under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return fn(notebook(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def register_raw(fn):
    """Register a function of (spark, sf_dir) under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def joined(c: str):
    return F.array_join(c, " | ").alias(c)


# -- cells and expressions ----------------------------------------------------

@register
def numeric_coercion(t):
    src = {"mass_g": "formulations", "value": "results", "purity_fraction": "reagents", "concentration": "reagents"}
    out = None
    for c, name in src.items():
        raw = F.when(F.substring("row_key", -1, 1) == "3", F.concat(F.lit(" 1,2"), F.col(c), F.lit(" g"))).otherwise(F.col(c))
        df = t[name].select(F.lit(c).alias("field"), raw.alias("raw")).select(
            "field", "raw",
            text.num_first_token(F.col("raw")).alias("first_token"), text.num_fraction(F.col("raw")).alias("fraction"),
            text.num_strict(F.col("raw")).alias("strict"), text.num_token(F.col("raw")).alias("token"))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("field", "raw", "first_token", "fraction", "strict", "token").agg(F.count("*").alias("n"))


@register
def unit_conversion(t):
    r = t["reagents"]
    spelled = F.element_at(
        F.array(*[F.lit(u) for u in ("M", "mmol / L", "µmol per L", "mol/mL", "mg per mL", "g L−1", "ug/mL", "wt. %", "w/w", "ppm", "")]),
        (F.col("row_key").cast("bigint") % 11 + 1).cast("int"))
    conc = text.num_first_token(F.col("molecular_weight_g_mol")) / 100
    return r.select("reagent_id", units.norm_units(spelled).alias("unit"), conc.alias("conc")).select(
        "reagent_id", "unit",
        F.round(units.to_molarity(F.col("conc"), F.col("unit")), 9).alias("molarity"),
        F.round(units.to_mass_concentration(F.col("conc"), F.col("unit")), 9).alias("mass_g_mL"),
        F.round(units.to_fraction(F.col("conc"), F.col("unit")), 9).alias("fraction"))


@register
def metric_key_classify(t):
    r = t["results"]
    return r.groupBy(
        metrics.metric_key(F.col("measurement_type"), F.col("units")).alias("metric_key"), "measurement_type", "units",
        metrics.prediction_metric_key(F.col("measurement_type"), F.col("method"), F.col("units"), F.col("condition")).alias("prediction_key"),
        "method", "condition",
    ).agg(F.count("*").alias("n"))


@register
def format_numbers(t):
    v = text.num_strict(F.col("value"))
    return t["results"].where(v.isNotNull()).select(
        "sample_id", text.fmt6(v / 7).alias("six_decimals"), text.fmt6(v * 1000).alias("thousands"),
        text.fmt6g(v * 1000 / 7).alias("six_digits"))


@register
def id_normalize(t):
    log = t["daily_log"]
    return log.select(
        "row_key", text.slugify(F.concat(F.lit(" "), "observation", F.lit("!"))).alias("slug"),
        text.compact_token(F.col("timestamp"), 32, "row").alias("compact"),
        text.compact_token(F.col("observation"), 48, "").alias("review_token"),
        text.evidence_prefix(F.concat("experiment_id", F.lit("/A b"))).alias("prefix"))


# -- formulations -------------------------------------------------------------

@register
def formulation_enrich(t):
    return formulation.enrich(t["formulations"], t["reagents"]).select(
        "experiment_id", "row_key", "reagent_id", "reagent_name", "reagent_category", "reagent_molecular_weight_g_mol",
        "reagent_density_g_mL", "reagent_purity_fraction", "reagent_concentration", "reagent_concentration_units")


@register
def formulation_quantities(t):
    return formulation.formulation_quantities(t).select(
        "experiment_id", "row_key", "reagent_id", "target_role", "derived_mass_g", "derived_volume_mL",
        "derived_moles_mmol", "derived_active_mass_g", "formulation_mass_total_g", "derived_wt_percent",
        F.array_join("missing_for_calculations", " | ").alias("missing"))


@register
def formulation_updates(t):
    return formulation.formulation_updates(t)


@register
def formulation_update_summary(t):
    return formulation.formulation_update_summary(t)


# -- selection ----------------------------------------------------------------

@register
def select_experiments(t):
    return select.select_experiments(t)


@register
def select_by_date(t):
    a = select.select_experiments(t, date=LOG_DATE).withColumn("review_date", F.lit(LOG_DATE))
    b = select.select_experiments(t, date=EXP_DATE).withColumn("review_date", F.lit(EXP_DATE))
    return a.unionByName(b)


@register
def open_suggestions(t):
    return select.suggestions_with_status(t).select(
        "suggestion_id", "experiment_id", "status", "proposed_experiment_id", "proposed_experiment_status")


@register
def suggestion_closure(t):
    return select.suggestion_closure(t)


# -- measurements -------------------------------------------------------------

@register
def log_unpivot(t):
    return log_results.log_measurements(t["daily_log"])


@register
def daily_log_results(t):
    return log_results.daily_log_results(t)


@register
def daily_log_summary(t):
    rows = log_results.daily_log_results(t)
    return log_results.daily_log_summary(t, rows)


@register
def measurement_dedupe(t):
    return results.measurement_dedupe(t)


@register
def target_evaluation(t):
    return results.target_evaluation(t).select(
        "experiment_id", "metric_key", "value", "units", "source", "row_key", "status", "priority", "guidance",
        joined("signals"))


@register
def limiting_metrics(t):
    return results.limiting_metrics(results.target_evaluation(t)).select(
        "experiment_id", "rank", "metric_key", "value", "units", "status")


@register
def experiment_signals(t):
    return results.experiment_signals(t)


@register
def result_analysis(t):
    return results.result_analysis(t).withColumns({
        "signals": F.array_join("signals", " | "), "guidance": F.array_join("guidance", " | ")})


@register
def current_metrics(t):
    return results.current_metrics(t)


# -- history ------------------------------------------------------------------

@register
def history_benchmarks(t):
    return history.history_benchmarks(t)


@register
def history_guidance(t):
    return history.history_guidance(t).withColumn("guidance", F.array_join("guidance", " | "))


# -- audits -------------------------------------------------------------------

@register
def role_coverage(t):
    return audit.role_coverage(t)


@register
def material_audit(t):
    return audit.material_audit(t).withColumns({
        "missing_required": F.array_join("missing_required", ","),
        "recommendations": F.array_join("recommendations", " | ")})


@register
def required_violations(t):
    return audit.required_violations(t)


@register
def vocab_violations(t):
    return audit.vocab_violations(t)


@register
def config_first_wins(t):
    return audit.first_config(t)


@register
def preflight_checks(t):
    return audit.preflight_checks(t, "review").withColumn("actions", F.array_join("actions", " | "))


@register
def preflight_summary(t):
    return audit.preflight_summary(t, "planning").withColumn("next_actions", F.array_join("next_actions", " | "))


# -- retrieval ----------------------------------------------------------------
from .operators import literature, search  # noqa: E402


def document_corpus(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return d, q


@register_raw
def tfidf_idf(spark, sf_dir):
    d, _ = document_corpus(spark, sf_dir)
    idf = search.inverse_document_frequency(search.term_counts(d, ["doc_id"]), d.agg(F.count("*").alias("docs")))
    return idf.withColumn("idf", F.round("idf", 9))


@register_raw
def tfidf_search(spark, sf_dir):
    d, q = document_corpus(spark, sf_dir)
    return search.tfidf_search(d, q, 5)


NOTEBOOK_QUERIES = [
    ("q1", "emulsion polymerization surfactant particle size coagulum latex feed"),
    ("q2", "low conversion initiator persulfate residual monomer"),
    ("q3", "acrylate latex grade small gizmo"),
    ("q4", "R-00012 core_monomer small unknowntoken"),
]


@register
def notebook_search(t):
    q = t["experiments"].sparkSession.createDataFrame(NOTEBOOK_QUERIES, "query_id string, text string")
    return search.notebook_search(t, q, 10)


@register
def query_build(t):
    return literature.build_queries(t)


@register
def context_search(t):
    queries = literature.build_queries(t, select.select_experiments(t, date=LOG_DATE))
    return search.context_search(t, queries, 5)


@register_raw
def work_tags(spark, sf_dir):
    w = works(spark, sf_dir)
    return w.select("work_id", F.array_join(literature.work_tags(F.lower(literature.search_text())), ",").alias("tags"),
                    literature.doi_url(F.col("doi")).alias("doi_url"), literature.work_year().alias("year"))


def work_queries(spark):
    return spark.createDataFrame(NOTEBOOK_QUERIES + [("EP-000007", "latex nucleation"), ("EP-000008", "oo zz qq")], "query_id string, text string")


@register_raw
def work_rerank(spark, sf_dir):
    r = literature.rank_works(works(spark, sf_dir), work_queries(spark), 12)
    return r.select("query_id", "doc_id", "rank", F.round("semantic", 6).alias("semantic"), "lexical")


@register_raw
def evidence_rows(spark, sf_dir):
    return literature.evidence_rows(works(spark, sf_dir), work_queries(spark), 5)


@register
def evidence_links(t):
    return literature.evidence_links(t)


@register
def literature_tag_counts(t):
    return literature.literature_tag_counts(literature.linked_evidence(t))


@register
def literature_findings(t):
    return literature.literature_findings(literature.linked_evidence(t))


@register
def evidence_matches(t):
    linked = literature.linked_evidence(t)
    return literature.evidence_matches(t, literature.build_queries(t, linked), linked)


@register
def evidence_select(t):
    linked = literature.linked_evidence(t)
    return literature.evidence_select(t, literature.build_queries(t, linked), linked, results.entry_signals(t)).select(
        "experiment_id", "rank", "evidence_id", "score")


# -- materials ----------------------------------------------------------------
from .adapters import records  # noqa: E402
from .contract import TABLES  # noqa: E402
from .operators import changes, daily, materials  # noqa: E402


@register
def material_candidates(t):
    return materials.material_candidates(t, 5, include_optional=True).withColumns({
        "match_reasons": F.array_join("match_reasons", ","), "missing_fields": F.array_join("missing_fields", ",")})


@register
def knowledge_matches(t):
    return materials.knowledge_matches(t, 3)


@register
def material_search(t):
    return materials.material_search(t, materials.material_candidates(t, 3))


@register
def material_scaffold(t):
    return materials.material_scaffold(t)


# -- day views ----------------------------------------------------------------

@register
def latest_observations(t):
    return daily.latest_observations(t["daily_log"])


@register
def issue_tags(t):
    return daily.issue_tags(t["daily_log"])


@register
def daily_windows(t):
    return daily.daily_windows(t["daily_log"])


@register
def next_actions(t):
    return daily.next_actions(t, select.select_experiments(t))


@register
def daily_summary(t):
    a = daily.daily_summary(t, LOG_DATE)
    return a.unionByName(daily.daily_summary(t, EXP_DATE))


# -- writes -------------------------------------------------------------------

@register
def apply_cell_updates(t):
    """Formulation updates written into the table, counted per field."""
    up = formulation.formulation_updates(t)
    new = changes.apply_updates(t["formulations"], up, ["experiment_id", "reagent_id", "target_role", "row_key"], written=True)
    return new.select("experiment_id", "row_key", "reagent_id", "target_role", "mass_g", "volume_mL", "moles_mmol", "wt_percent")


@register
def projected_results(t):
    """Results with the normalised log rows appended, counted per experiment and flag."""
    return changes.append_rows(t["results"], log_results.daily_log_results(t), "results").groupBy(
        "experiment_id", "measurement_type", "method").agg(F.count("*").alias("n"))


@register
def rerun_noop(t):
    """A second run over its own output finds nothing to append."""
    first = changes.append_rows(t["results"], log_results.daily_log_results(t), "results")
    again = log_results.not_recorded(log_results.log_cells(t["daily_log"]), first)
    return again.agg(F.count("*").alias("second_run_rows"))


@register
def batch_signature(t):
    return changes.batch_signature(formulation.formulation_updates(t).drop("row_key", "duplicate_cells"))


def proposed_changes(t):
    s, f, c = t["suggestions"], t["formulations"], t["config"]
    appends = {
        "experiments": s.select(F.col("proposed_experiment_id").alias("experiment_id")),
        "formulations": f.where("feed_order in ('1','2')").select(
            F.when(F.col("feed_order") == "1", F.concat("experiment_id", F.lit("-X"))).otherwise(F.col("experiment_id")).alias("experiment_id"),
            "reagent_id", "target_role"),
        "reviews": c.where("cast(row_key as bigint) % 30 = 0").select(
            F.concat(F.lit("DRV-20240105-EP"), F.substring("row_key", 7, 6)).alias("review_id")),
    }
    updates = {
        "suggestions": s.select(F.concat("suggestion_id", F.when(F.col("status") == "draft", "-Z").otherwise("")).alias("suggestion_id")),
        "reagents": t["reagents"].select(F.concat(F.lit("R-"), F.lpad((F.substring("row_key", 3, 10).cast("bigint") + 1000).cast("string"), 5, "0")).alias("reagent_id")),
    }
    return appends, updates


@register
def apply_audit(t):
    return changes.apply_audit(t, *proposed_changes(t))


@register
def fold_updates(t):
    """Updates for rows that are themselves being appended, and the updates left over."""
    up = formulation.formulation_updates(t)
    keys = ["experiment_id", "reagent_id", "target_role"]
    new = t["formulations"].where("feed_order = '3'")
    folded, rest = changes.fold_updates(new, up, keys)
    a = folded.groupBy(F.lit("appended").alias("part"), F.lit("").alias("field")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("mass_g") != "", 1)).alias("with_mass"))
    b = rest.groupBy(F.lit("left over").alias("part"), "field").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("with_mass"))
    return a.unionByName(b)


@register
def rows_not_present(t):
    """Reagents of one notebook that another does not hold."""
    other = t["formulations"].where("feed_order = '3' and notes <> ''").select("reagent_id")
    return changes.rows_not_present(t["reagents"], other, "reagent_id").select("reagent_id", "name")


@register
def linked_ids_update(t):
    linked = literature.literature_findings(literature.linked_evidence(t), 3)
    return changes.linked_ids_update(t["experiments"].select("experiment_id", "linked_literature_ids"), linked)


@register_raw
def record_ingest(spark, sf_dir):
    rows = changes.record_rows(records(spark, sf_dir))
    out = None
    for name in ("experiments", "formulations", "daily_log", "results"):
        shown = {
            "experiments": ["date", "process_type", "status"], "formulations": ["reagent_id", "target_role", "mass_g"],
            "daily_log": ["timestamp", "process_stage", "observation"], "results": ["sample_id", "measurement_type", "value", "quality_flag"],
        }[name]
        df = rows[name].select(F.lit(TABLES[name].title).alias("table_name"), "row_key", "experiment_id",
                               F.concat_ws(" | ", *shown).alias("cells"))
        out = df if out is None else out.unionByName(df)
    return out


@register_raw
def record_warnings(spark, sf_dir):
    return changes.record_warnings(changes.record_rows(records(spark, sf_dir)))


@register_raw
def reagent_merge(spark, sf_dir):
    return changes.reagent_merge(changes.record_rows(records(spark, sf_dir))["reagents"]).select(
        "reagent_id", "name", "category", "hazards", "row_key")


@register_raw
def reagent_reconcile(spark, sf_dir):
    merged = changes.reagent_merge(changes.record_rows(records(spark, sf_dir))["reagents"])
    return changes.reagent_reconcile(merged, notebook(spark, sf_dir)["reagents"])


# -- lifecycle ----------------------------------------------------------------
from .operators import followup  # noqa: E402
from .plans import agent, daily_run as day_plan, materialize, recommend  # noqa: E402

NOW = "2026-06-10T08:00:00"


def chosen_evidence(t):
    linked = literature.linked_evidence(t)
    return cut(literature.evidence_select(t, literature.build_queries(t, linked), linked, results.entry_signals(t)))


def drafts(t, chosen=None):
    context = recommend.literature_context(chosen_evidence(t) if chosen is None else chosen, literature.tags_or_inferred())
    return cut(recommend.recommendations(t, cut(results.experiment_signals(t)), context, cut(day_plan.entry_knowledge(t))))


@register
def next_followup_id(t):
    return followup.next_followup_ids(t)


@register
def followup_adjustments(t):
    return followup.followup_adjustments(
        t, results.experiment_signals(t), literature.literature_tag_counts(literature.linked_evidence(t)))


@register
def plan_rows(t):
    # read by both steps, made once
    signals = cut(results.experiment_signals(t))
    return followup.plan_formulations(t, signals, cut(followup.followup_adjustments(t, signals)))


@register
def plan_roundtrip(t):
    p = materialize.accepted_plans({**t, "suggestions": t["suggestions"].withColumn("status", F.lit("accepted"))})
    again = F.from_json(F.to_json("plan"), materialize.PLAN)
    return p.select("suggestion_id", "has_plan", "planned_id", F.col("plan.objective").alias("objective"),
                    F.array_join("plan.measurements", ",").alias("measurements"),
                    F.when(F.col("has_plan"), F.to_json(again) == F.to_json("plan")).alias("same"))


@register
def plan_materialize(t):
    m = materialize.materialize(t, "2026-07-01")
    shown = {
        "experiments": ["date", "process_type", "objective", "linked_literature_ids", "status", "planned_next_step"],
        "formulations": ["reagent_id", "target_role", "mass_g", "volume_mL", "moles_mmol", "wt_percent", "concentration", "notes"],
        "results": ["sample_id", "measurement_type", "units", "condition", "quality_flag", "interpretation"],
    }
    out = None
    for name, cols in shown.items():
        df = m[name].select(F.lit(TABLES[name].title).alias("table_name"), "suggestion_id", "row_key", "experiment_id",
                            F.concat_ws(" | ", *cols).alias("cells"))
        out = df if out is None else out.unionByName(df)
    return out


@register
def plan_runs(t):
    return materialize.materialize(t, "2026-07-01")["runs"]


@register
def config_parse(t):
    return agent.parse_config(t)


@register
def recommendation(t):
    return drafts(t)


@register
def agent_gates(t):
    ev = chosen_evidence(t)
    return agent.agent_gates(select.select_experiments(t), t, drafts(t, ev), ev, "medium", True)


@register
def safety_gate(t):
    return t["suggestions"].select("suggestion_id", agent.safety_class(F.col("safety_check")).alias("safety"))


@register
def required_metric_gaps(t):
    return agent.required_metric_gaps(t)


def gated(t):
    ev = chosen_evidence(t)
    d = drafts(t, ev)
    g = cut(agent.agent_gates(select.select_experiments(t), t, d, ev, "low", False))
    return g, agent.prediction_gaps(t, g, d)


@register
def prediction_gaps(t):
    return gated(t)[1]


@register
def prediction_summary(t):
    return agent.prediction_summary(agent.prediction_status(*gated(t)))


def pending(t):
    return day_plan.pending_writes(
        log_results.daily_log_results(t), formulation.formulation_updates(t),
        literature.literature_findings(literature.linked_evidence(t), 3), select.open_suggestions(t))


@register
def pending_writes(t):
    return pending(t)


@register
def experiment_updates(t):
    day = daily.daily_experiments(t, select.select_experiments(t))
    return day_plan.experiment_updates(t, LOG_DATE, day, audit.preflight_summary(t, "review"), pending(t))


@register
def daily_review(t):
    """The review row of a day, from that day's own writes; the open suggestion drafts of its experiments stand for new ones."""
    selected = cut(select.select_experiments(t, date=LOG_DATE))
    day = daily.daily_experiments(t, selected)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    of_day = lambda df: lookup(df, selected.select("experiment_id").distinct(), ["experiment_id"], "left_semi")
    totals = daily.daily_summary(t, LOG_DATE).select("experiment_count", "observation_count", "result_count")
    for one in (
        count(formulation.formulation_updates(t, selected), "formulation_cells_to_update"),
        count(select.suggestion_closure(t), "suggestion_rows_to_update"),
        count(log_results.daily_log_results(t, selected, LOG_DATE), "normalized_result_rows_to_append"),
        count(literature.linked_evidence({**t, "experiments": of_day(t["experiments"])}), "evidence_rows_to_append"),
        count(of_day(t["suggestions"].where("status = 'draft'")), "suggestion_rows_to_append"),
        audit.preflight_summary(t, "review", day).agg(
            F.sum("fail_count").alias("preflight_fail_count"), F.sum("warn_count").alias("preflight_warn_count")),
    ):
        totals = totals.crossJoin(F.broadcast(one))  # one-row frames
    return day_plan.daily_review(LOG_DATE, NOW, day, totals)


@register_raw
def daily_run_summary(spark, sf_dir):
    t = notebook(spark, sf_dir)
    return day_plan.daily_run(t, LOG_DATE, NOW, works=works(spark, sf_dir))["totals"]


# -- sources ------------------------------------------------------------------
from .sources import tables as sources  # noqa: E402


@register
def scan_clean_rows(t):
    """Trimmed log rows without the fully blank ones."""
    raw = t["daily_log"].select("row_key", F.when(F.col("issue_tags") == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), "issue_tags")).alias("issue_tags"),
                                F.when(F.col("process_stage") == "wait", F.lit(None)).otherwise(F.col("process_stage")).alias("process_stage"))
    return sources.clean(raw, "daily_log").select("row_key", "process_stage", "issue_tags", "experiment_id")


@register
def snapshot_roundtrip(t):
    """Experiments written as header-and-values rows and read back."""
    cols = list(TABLES["experiments"].columns)
    rows = sources.snapshot_rows({**t}).where("title = 'Experiments'")
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), "values")
    back = rows.select("row_key", pairs.alias("row")).select("row_key", *[F.try_element_at("row", F.lit(c)).alias(c) for c in cols])
    return sources.clean(back, "experiments").select("experiment_id", "date", "process_type", "objective", "status")


@register_raw
def works_scan(spark, sf_dir):
    w = works(spark, sf_dir)
    return w.select("work_id", "title", "source", F.size("authors").alias("authors"), F.array_join("concepts", ",").alias("concepts"))
