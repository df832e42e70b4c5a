"""Notebook table contracts: ordered columns, required flags, vocabularies.

Every cell is a string and a blank cell is ``''``.  ``row_key`` is an extra,
sortable text column giving the position of a row in its table; "first row
wins" rules are expressed as ``min`` over it, so no operator ever needs a
global row number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ROW_KEY = "row_key"

# ---------------------------------------------------------------------------
# Vocabularies and table layouts of the notebook format.
# ---------------------------------------------------------------------------
PROCESS_TYPES = [
    "emulsion polymerization", "solution polymerization", "bulk polymerization",
    "suspension polymerization", "latex characterization", "compounding", "hydrolysis study",
]
REAGENT_CATEGORIES = [
    "monomer", "initiator", "surfactant", "solvent", "buffer", "chain_transfer_agent",
    "crosslinker", "inhibitor", "additive", "matrix_polymer", "unknown",
]
FORMULATION_ROLES = [
    "core_monomer", "shell_monomer", "comonomer", "initiator", "surfactant", "buffer",
    "chain_transfer_agent", "crosslinker", "solvent", "neutralizer", "additive",
]
EXPERIMENT_STATUS = ["planned", "running", "complete", "needs_review", "abandoned"]
PROCESS_STAGES = ["setup", "seed", "feed", "hold", "chase", "workup", "sampling", "test", "cleanup"]
QUALITY_FLAGS = ["planned", "observed", "ok", "suspect", "repeat", "failed"]
SUGGESTION_STATUS = ["draft", "accepted", "rejected", "run_planned", "run_complete"]
REVIEW_STATUS = ["needs_attention", "ready_to_apply", "ready_with_warnings", "no_action"]


@dataclass(frozen=True)
class Table:
    """One notebook table: ``columns`` in order, which are required, its keys."""

    name: str
    title: str
    columns: tuple[str, ...]
    required: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    vocab: dict[str, list[str]] = field(default_factory=dict)
    label: tuple[str, ...] = ()
    search_key: tuple[str, ...] = ()

    def schema(self) -> T.StructType:
        fields = [T.StructField(ROW_KEY, T.StringType())]
        for c in self.columns:
            meta = {"required": c in self.required}
            if c in self.vocab:
                meta["vocab"] = self.vocab[c]
            fields.append(T.StructField(c, T.StringType(), True, meta))
        return T.StructType(fields)


def _cols(text: str) -> tuple[str, ...]:
    return tuple(text.split())


TABLES: dict[str, Table] = {
    t.name: t
    for t in [
        Table(
            "reagents", "Master Reagents",
            _cols("reagent_id name common_name category role molecular_weight_g_mol density_g_mL "
                  "purity_fraction concentration concentration_units supplier lot storage_location hazards notes"),
            required=_cols("reagent_id name category"), key=("reagent_id",),
            vocab={"category": REAGENT_CATEGORIES},
            label=_cols("reagent_id name common_name"),
            search_key=_cols("reagent_id name common_name category role"),
        ),
        Table(
            "experiments", "Experiments",
            _cols("experiment_id date project process_type objective hypothesis linked_literature_ids "
                  "operator status planned_next_step summary"),
            required=_cols("experiment_id date process_type objective status"), key=("experiment_id",),
            vocab={"process_type": PROCESS_TYPES, "status": EXPERIMENT_STATUS},
            label=_cols("experiment_id process_type objective"),
            search_key=_cols("experiment_id date process_type objective status"),
        ),
        Table(
            "daily_log", "Daily Log",
            _cols("experiment_id timestamp process_stage temperature_C rpm pH solids_percent particle_size_nm "
                  "conversion_percent viscosity_cP observation issue_tags attachments_url "
                  "residual_monomer_percent polydispersity_index Tg_C hold_time_min"),
            required=_cols("experiment_id timestamp observation"),
            key=_cols("experiment_id timestamp observation"),
            vocab={"process_stage": PROCESS_STAGES},
            label=_cols("experiment_id timestamp issue_tags"),
            search_key=_cols("experiment_id timestamp process_stage issue_tags"),
        ),
        Table(
            "formulations", "Formulations",
            _cols("experiment_id reagent_id phase target_role mass_g volume_mL moles_mmol concentration "
                  "concentration_units wt_percent feed_order feed_start_min feed_duration_min notes"),
            required=_cols("experiment_id reagent_id target_role"),
            key=_cols("experiment_id reagent_id target_role"),
            vocab={"target_role": FORMULATION_ROLES},
            search_key=_cols("experiment_id reagent_id phase target_role"),
        ),
        Table(
            "results", "Results",
            _cols("experiment_id sample_id measurement_type method value units condition replicate "
                  "quality_flag interpretation"),
            required=_cols("experiment_id sample_id measurement_type"),
            key=_cols("experiment_id sample_id measurement_type"),
            vocab={"quality_flag": QUALITY_FLAGS},
            label=_cols("experiment_id measurement_type value units"),
            search_key=_cols("experiment_id sample_id measurement_type value units"),
        ),
        Table(
            "evidence", "Literature Evidence",
            _cols("evidence_id source title authors year doi_or_url query finding relevance_tags confidence notes"),
            required=_cols("evidence_id finding"), key=("evidence_id",),
            label=_cols("evidence_id title"),
            search_key=_cols("evidence_id source title relevance_tags"),
        ),
        Table(
            "suggestions", "Agent Suggestions",
            _cols("suggestion_id created_at experiment_id recommendation_type rationale proposed_change "
                  "expected_effect linked_evidence_ids safety_check confidence status "
                  "proposed_experiment_id proposed_plan_json"),
            required=_cols("suggestion_id experiment_id"), key=("suggestion_id",),
            vocab={"status": SUGGESTION_STATUS},
            search_key=_cols("suggestion_id experiment_id recommendation_type status"),
        ),
        Table(
            "reviews", "Daily Reviews",
            _cols("review_id created_at review_date selected_experiment_ids experiment_count observation_count "
                  "result_count normalized_result_rows_to_append evidence_rows_to_append "
                  "suggestion_rows_to_append preflight_fail_count preflight_warn_count apply_request_count "
                  "status summary next_actions_json"),
            required=_cols("review_id review_date"), key=("review_id",),
            vocab={"status": REVIEW_STATUS},
            label=_cols("review_id review_date status"),
            search_key=_cols("review_id review_date selected_experiment_ids status"),
        ),
        Table(
            "knowledge", "Process Knowledge",
            _cols("process_type material_role typical_examples measured_fields guidance search_terms"),
            required=("process_type",),
            search_key=_cols("process_type material_role typical_examples"),
        ),
        Table("vocab", "Controlled Vocab", _cols("field allowed_value description"),
              key=_cols("field allowed_value")),
        Table("config", "Agent Config", _cols("key value notes"), required=("key",), key=("key",)),
    ]
}

SEARCH_TABLES = ("reagents", "experiments", "daily_log", "formulations", "results",
                 "evidence", "suggestions", "reviews", "knowledge")
BY_TITLE = {t.title: t for t in TABLES.values()}


def contract_rows() -> list[tuple]:
    """(table, position, column, required, vocabulary size) for every contract column."""
    return [
        (t.title, i, c, c in t.required, len(t.vocab.get(c, [])))
        for t in TABLES.values()
        for i, c in enumerate(t.columns, start=1)
    ]


def vocab_rows() -> list[tuple[str, str, str]]:
    """(table, field, allowed value) for every controlled vocabulary."""
    return [
        (t.name, c, v) for t in TABLES.values() for c, values in t.vocab.items() for v in values
    ]
