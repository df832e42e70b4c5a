"""The daily run: everything for one review date, from selection to the review row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..contract import ROW_KEY, TABLES
from ..functions.joins import lookup
from ..functions.text import key_values, text, words
from ..operators import change_set, changes, daily, formulation, literature, log_results, results
from ..operators.audit import material_audit, preflight_summary
from ..operators.history import history_guidance
from ..operators.results import result_analysis
from ..operators.search import QUERY_TOKENS, TASK_PAIRS, best, inverse_document_frequency, term_counts, top_k
from ..operators.select import experiments_once, select_experiments, suggestion_closure
from ..session import cut
from .agent import agent_gates
from .document import proposed_plans, suggestions_with_plans
from .recommend import literature_context, recommendations


def entry_knowledge(t: dict[str, DataFrame], k: int = 1, selected: DataFrame | None = None) -> DataFrame:
    """Best process-knowledge rows for the text of each experiment: (experiment_id, rank, score, summary)."""
    docs = t["knowledge"].select(F.col(ROW_KEY).alias("doc_id"), key_values([(c, c) for c in TABLES["knowledge"].columns]).alias("text"))
    tf = cut(term_counts(docs, ["doc_id"]))
    idf = inverse_document_frequency(tf, docs.agg(F.count("*").alias("docs")))
    keep = cut(experiments_once(t).select("experiment_id") if selected is None else selected.select("experiment_id").distinct())
    # rows of others are left out as they are, and a reagent is tokenised once however many rows use it
    pieces = literature.entry_pieces(t, keep, gained=words)
    read = literature.with_gained(words(F.col("text")), "gained")
    q = pieces.select("experiment_id", F.explode(read).alias("token")).groupBy("experiment_id", "token").agg(F.count("*").alias("n"))
    q = lookup(q, idf.drop("df"), ["token"])
    # the length of an experiment's text cancels out of the cosine; written once, read for norms and matches
    q = cut(q.select("experiment_id", "token", (F.col("n") * F.coalesce("idf", F.lit(1.0))).alias("qw"), F.col("idf").isNotNull().alias("known")))
    d = lookup(tf, idf.drop("df"), ["token"], "inner").withColumn("dw", F.col("n") / F.col("total") * F.col("idf"))
    norm = lambda df, key, w: df.groupBy(key).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("norm_" + w))
    d = lookup(d.select("doc_id", "token", "dw"), norm(d, "doc_id", "dw"), ["doc_id"], "inner").select(
        "doc_id", "token", (F.col("dw") / F.col("norm_dw")).alias("dw"))
    asked = q.where("known")
    if tf.count() <= QUERY_TOKENS:
        # every task holds the knowledge: pairs are added up where the tokens of an experiment are and never shuffled
        tasks = -(-q.select("experiment_id").distinct().count() * docs.count() // TASK_PAIRS)
        hits = asked.select("experiment_id", "token", "qw").repartition(max(tasks, 1), "experiment_id").join(F.broadcast(d), "token")
    else:
        hits = asked.select("experiment_id", "token", "qw").join(d, "token")
    dots = hits.groupBy("experiment_id", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("dot"))
    s = lookup(dots, norm(q, "experiment_id", "qw"), ["experiment_id"], "inner")
    s = s.withColumn("score", F.col("dot") / F.col("norm_qw")).where("score > 0")
    out = top_k(s, k, ["experiment_id"], best("doc_id"))
    return lookup(out, t["knowledge"].select(F.col(ROW_KEY).alias("doc_id"), F.col("guidance").alias("summary")), ["doc_id"], "inner").select(
        "experiment_id", "rank", F.round("score", 4).alias("score"), "summary")


def pending_writes(log_rows: DataFrame, updates: DataFrame, evidence: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Pending rows and cells per (experiment, kind) in columns."""
    part = lambda df, kind: df.groupBy("experiment_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    long = part(log_rows, "results").unionByName(part(updates, "formulation_cells")).unionByName(
        part(evidence, "evidence")).unionByName(part(suggestions, "suggestions"))
    kinds = ["results", "formulation_cells", "evidence", "suggestions"]
    return long.groupBy("experiment_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("bigint").alias(k) for k in kinds])


def experiment_updates(
    t: dict[str, DataFrame], date: str, day: DataFrame, preflight: DataFrame, pending: DataFrame, evidence: DataFrame | None = None
) -> DataFrame:
    """Cells of Experiments that change after the review: status, next step, summary and linked evidence."""
    df = lookup(experiments_once(t), day.select("experiment_id", "observation_count", "result_count"), ["experiment_id"], "inner")
    df = lookup(df, preflight.select("experiment_id", "fail_count", "warn_count", "next_actions"), ["experiment_id"])
    df = lookup(df, pending, ["experiment_id"])
    kinds = ("results", "formulation_cells", "evidence", "suggestions")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    writes = n(kinds[0]) + n(kinds[1]) + n(kinds[2]) + n(kinds[3])
    first = F.get("next_actions", F.lit(0))
    status = (
        F.when(F.lower(F.trim("status")) == "abandoned", "")
        .when((n("fail_count") > 0) | (writes > 0) | (n("warn_count") > 0), "needs_review")
        .when((n("observation_count") > 0) | (n("result_count") > 0), "complete").otherwise(""))
    step = (
        F.when(n("fail_count") > 0, first)
        .when(n("suggestions") > 0, "Review draft Agent Suggestions and set status to accepted or rejected before materialization.")
        .when(n("results") > 0, "Review normalized Daily Log measurements in Results.")
        .when(n("formulation_cells") > 0, "Review normalized Formulations quantities before relying on follow-up calculations.")
        .when(n("evidence") > 0, "Review appended Literature Evidence before relying on it.").otherwise(first))
    s = lambda c: n(c).cast("string")
    summary = F.concat(
        F.lit(f"Daily review {date}: "), s("observation_count"), F.lit(" observations; "), s("result_count"), F.lit(" existing Results rows; "),
        s("results"), F.lit(" normalized Results pending; "), s("formulation_cells"), F.lit(" normalized Formulations pending; "),
        s("evidence"), F.lit(" evidence rows pending; "), s("suggestions"), F.lit(" suggestion rows pending; "),
        s("fail_count"), F.lit(" preflight failures."))
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.trim(text(F.col(f))).alias("old"), F.trim(v).alias("value"))
        for f, v in (("status", status), ("planned_next_step", step), ("summary", summary))])
    out = df.select("experiment_id", F.inline(cells)).where("value <> '' and value <> old").drop("old")
    if evidence is not None:
        links = changes.linked_ids_update(lookup(experiments_once(t), day.select("experiment_id"), ["experiment_id"], "left_semi"), evidence)
        out = out.unionByName(links)
    return out


def daily_review(date: str, created_at: str, day: DataFrame, totals: DataFrame) -> DataFrame:
    """The review row of the day.

    ``day`` is one row per selected experiment, ``totals`` one row of counts.  The
    reviewed experiments are named by their number and an order-independent digest of
    their ids, in the same form for a day of any size; ``review_members`` lists them.
    """
    whole = changes.batch_signature(day.select("experiment_id"))
    df = totals.crossJoin(F.broadcast(whole))  # two one-row frames
    members = F.concat(F.col("row_count").cast("string"), F.lit("x"), "signature")
    token = F.when(F.col("row_count") == 0, "all").otherwise(members)
    c = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint")
    pend = ["normalized_result_rows_to_append", "formulation_cells_to_update", "evidence_rows_to_append",
            "suggestion_rows_to_append", "suggestion_rows_to_update"]
    pending = c(pend[0]) + c(pend[1]) + c(pend[2]) + c(pend[3]) + c(pend[4])
    status = (
        F.when(c("preflight_fail_count") > 0, "needs_attention").when(pending > 0, "ready_to_apply")
        .when(c("preflight_warn_count") > 0, "ready_with_warnings").otherwise("no_action"))
    s = lambda x: c(x).cast("string")
    summary = F.concat(
        s("experiment_count"), F.lit(" experiments; "), s(pend[0]), F.lit(" normalized Results rows; "), s(pend[1]), F.lit(" normalized Formulations cells; "),
        s(pend[2]), F.lit(" evidence rows; "), s(pend[3]), F.lit(" suggestion rows; "), s(pend[4]), F.lit(" suggestion status updates; "),
        s("preflight_fail_count"), F.lit(" preflight failures."))
    says = [
        (pend[0], "Apply or review normalized Daily Log measurements in Results."),
        (pend[1], "Apply or review normalized Formulations quantities before relying on follow-up calculations."),
        (pend[2], "Review appended Literature Evidence rows before relying on them."),
        (pend[3], "Review draft Agent Suggestions and set status to accepted or rejected."),
        (pend[4], "Apply Agent Suggestions status updates for completed planned follow-ups."),
    ]
    acts = F.array_compact(F.array(*[F.when(c(k) > 0, F.lit(v)) for k, v in says]))
    acts = F.when(F.size(acts) > 0, acts).otherwise(F.array(F.lit("No notebook write actions were generated for this daily run.")))
    return df.select(
        F.concat(F.lit(f"DRV-{date.replace('-', '')}-"), token).alias("review_id"), F.lit(created_at).alias("created_at"), F.lit(date).alias("review_date"),
        members.alias("selected_experiment_ids"),
        *[c(x).alias(x) for x in ("experiment_count", "observation_count", "result_count", pend[0], pend[2], pend[3], "preflight_fail_count", "preflight_warn_count")],
        status.alias("status"), summary.alias("summary"), F.to_json(acts).alias("next_actions_json"))


def review_actions(t: dict[str, DataFrame], day: DataFrame, preflight: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per-experiment lines of the review's action list, (experiment_id, action), in long form."""
    limits = lookup(analysis.where("limiting_count > 0"), day.select("experiment_id"), ["experiment_id"], "left_semi").select(
        "experiment_id", F.concat(F.lit("Review result limits for "), "experiment_id", F.lit(": "), F.get("guidance", F.lit(0))).alias("action"))
    checks = preflight.select("experiment_id", F.explode("next_actions").alias("action"))
    return limits.unionByName(checks)


def review_members(review: DataFrame, day: DataFrame) -> DataFrame:
    """(review_id, experiment_id) for every reviewed experiment."""
    return day.select("experiment_id").crossJoin(F.broadcast(review.select("review_id")))  # one review


def daily_run(
    t: dict[str, DataFrame], date: str, created_at: str, ids: list[str] | None = None, works: DataFrame | None = None,
    history_limit: int = 5, evidence_limit: int = 3, confidence_floor: str = "low", require_evidence: bool = False, force: bool = False,
) -> dict[str, DataFrame]:
    """All outputs of a daily run.  Results that several outputs build on are written once in between.

    Summary, log rows and experiment updates read the notebook as it is;
    formulation updates, gates and preflight read it with the pending log rows
    and quantities projected in.
    """
    selected = cut(select_experiments(t, ids, date))
    day = daily.daily_experiments(t, selected)
    log_rows = cut(log_results.daily_log_results(t, selected, date))
    # the projected tables are read by almost every output below
    p = {**t, "results": cut(changes.append_rows(t["results"], log_rows, "results"))}
    updates = cut(formulation.formulation_updates(p, selected))
    p["formulations"] = cut(changes.apply_updates(t["formulations"], updates, ["experiment_id", "reagent_id", "target_role", ROW_KEY]))
    signals = results.entry_signals(p)
    linked = lookup(literature.linked_evidence(p), selected, ["experiment_id"], "left_semi")
    queries = cut(literature.build_queries(p, selected))
    chosen = cut(literature.evidence_select(p, queries, linked, signals, evidence_limit))
    fresh = None
    if works is not None:
        bare = lookup(queries, linked.select("experiment_id").distinct(), ["experiment_id"], "left_anti")
        made = literature.evidence_rows(works, bare.withColumnRenamed("experiment_id", "query_id"), evidence_limit)
        fresh = changes.rows_not_present(made, t["evidence"], "evidence_id")
        chosen = chosen.unionByName(made.withColumns({
            "rank": F.substring("evidence_id", -3, 3).cast("int"), "score": F.lit(0.0), ROW_KEY: F.col("evidence_id"),
        }).select(*chosen.columns))
    context = literature_context(chosen, literature.tags_or_inferred())
    all_signals = cut(results.experiment_signals(p))
    sides = {"audit": cut(material_audit(p)), "analysis": cut(result_analysis(p)), "history": cut(history_guidance(p, history_limit))}
    rec = cut(recommendations(p, all_signals, context, cut(entry_knowledge(p, 1, selected)), history_limit, **sides))
    gates = agent_gates(selected, p, rec, chosen, confidence_floor, require_evidence, force)
    ready = gates.where("status = 'ready'").select("experiment_id")
    plans = lookup(proposed_plans(p, all_signals, context, history_limit, **sides), ready, ["experiment_id"], "left_semi")
    drafts = cut(suggestions_with_plans(lookup(rec, ready, ["experiment_id"], "left_semi"), plans, created_at))
    pre = preflight_summary(p, "review", selected)
    evidence_rows = fresh if fresh is not None else chosen.where(F.lit(False))
    pending = pending_writes(log_rows, updates, evidence_rows, drafts)
    closure = suggestion_closure(t)
    exp_updates = experiment_updates(t, date, day, pre, pending, chosen.select("experiment_id", "evidence_id", "rank"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    totals = day.agg(
        F.count("*").alias("experiment_count"), F.sum("observation_count").alias("observation_count"), F.sum("result_count").alias("result_count"))
    for one in (  # one-row frames
        count(log_rows, "normalized_result_rows_to_append"), count(updates, "formulation_cells_to_update"),
        count(evidence_rows, "evidence_rows_to_append"), count(drafts, "suggestion_rows_to_append"), count(closure, "suggestion_rows_to_update"),
        pre.agg(F.sum("fail_count").alias("preflight_fail_count"), F.sum("warn_count").alias("preflight_warn_count")),
    ):
        totals = totals.crossJoin(F.broadcast(one))
    review = daily_review(date, created_at, day, totals)
    run = {
        "day": day, "append_results": log_rows, "update_formulations": updates, "evidence": chosen, "append_evidence": evidence_rows,
        "recommendations": rec, "gates": gates, "append_suggestions": drafts, "preflight": pre, "pending": pending,
        "update_suggestions": closure, "update_experiments": exp_updates, "append_reviews": review, "totals": totals,
    }
    return {**run, "change_set": change_set.of_run(run, f"daily {created_at}")}


def recorded_daily_run(t: dict[str, DataFrame], records: DataFrame, date: str, created_at: str, **options) -> dict[str, DataFrame]:
    """Ingest experiment records, then run the day over the notebook with them in it.

    Updates that fall on rows of the record are folded into those rows.
    """
    rows = changes.record_rows(records)
    merged = changes.reagent_merge(rows["reagents"])
    moves = changes.reagent_reconcile(merged, t["reagents"])
    new_ids = moves.where("action = 'append'").select("reagent_id").distinct()
    new_reagents = lookup(merged, new_ids, ["reagent_id"], "left_semi")
    fills = moves.where("action = 'fill'").select("reagent_id", "field", F.col("proposed_value").alias("value"))
    p = {**t}
    p["reagents"] = changes.append_rows(changes.apply_updates(t["reagents"], fills, ["reagent_id"]), new_reagents, "reagents")
    for name in ("experiments", "formulations", "daily_log", "results"):
        p[name] = changes.append_rows(t[name], rows[name], name)
    ids = rows["experiments"].select("experiment_id").distinct()
    run = daily_run(p, date, created_at, ids=ids, **options)
    new_exp, exp_rest = changes.fold_updates(rows["experiments"], run["update_experiments"], ["experiment_id"])
    new_frm, frm_rest = changes.fold_updates(rows["formulations"], run["update_formulations"], ["experiment_id", "reagent_id", "target_role"])
    out = {
        **run, "append_reagents": new_reagents, "update_reagents": fills, "conflicts": moves.where("action = 'conflict'"),
        "append_experiments": new_exp, "append_formulations": new_frm, "append_daily_log": rows["daily_log"],
        "append_results": changes.append_rows(rows["results"], run["append_results"], "results"), "update_experiments": exp_rest, "update_formulations": frm_rest,
        "warnings": changes.record_warnings({**rows, "reagents": new_reagents}),
    }
    return {**out, "change_set": change_set.of_run(out, f"recorded {created_at}")}
