"""Fixed values of the notebook domain: role groups, measurement patterns, tags, texts."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Material role groups of emulsion polymerization.
# ---------------------------------------------------------------------------
QUANTITY_FIELDS = ["mass_g", "volume_mL", "moles_mmol", "wt_percent", "concentration"]
WRITTEN_QUANTITIES = ["mass_g", "volume_mL", "moles_mmol", "wt_percent"]

ROLE_GROUPS = {
    "monomer": {
        "required": True,
        "roles": ["core_monomer", "shell_monomer", "comonomer", "monomer"],
        "extra_terms": [],
        "examples": ["acrylate monomer", "methacrylate monomer", "functional comonomer"],
        "fields": ["molecular_weight_g_mol", "density_g_mL"],
    },
    "initiator": {
        "required": True,
        "roles": ["initiator"],
        "extra_terms": [],
        "examples": ["ammonium persulfate", "potassium persulfate", "redox initiator"],
        "fields": ["molecular_weight_g_mol"],
    },
    "surfactant": {
        "required": True,
        "roles": ["surfactant"],
        "extra_terms": [],
        "examples": ["anionic surfactant", "nonionic surfactant", "mixed surfactant package"],
        "fields": ["molecular_weight_g_mol", "concentration"],
    },
    "aqueous_phase": {
        "required": False,
        "roles": ["solvent", "buffer", "neutralizer"],
        "extra_terms": ["aqueous", "solvent", "water", "buffer"],
        "examples": ["deionized water", "buffer", "pH adjuster"],
        "fields": [],
    },
    "crosslinker_or_chain_transfer": {
        "required": False,
        "roles": ["crosslinker", "chain_transfer_agent"],
        "extra_terms": ["crosslinker", "chain_transfer_agent", "chain transfer"],
        "examples": ["divinyl ester", "diacrylate", "chain transfer agent"],
        "fields": ["molecular_weight_g_mol"],
    },
}
REQUIRED_GROUPS = [g for g, s in ROLE_GROUPS.items() if s["required"]]

# starter rows for a role group without material:
# (target role, phase, feed order, feed start, feed duration, category, name, common name, id suffix)
STARTER_ROWS = {
    "monomer": ("core_monomer", "monomer feed", "1", "0", "180", "monomer",
                "TODO monomer or comonomer", "TODO monomer", "MONOMER"),
    "initiator": ("initiator", "initiator feed", "2", "0", "210", "initiator",
                  "TODO initiator", "TODO initiator", "INITIATOR"),
    "surfactant": ("surfactant", "aqueous", "0", "", "", "surfactant",
                   "TODO surfactant", "TODO surfactant", "SURFACTANT"),
    "aqueous_phase": ("solvent", "aqueous", "0", "", "", "solvent",
                      "deionized water", "DI water", "WATER"),
    "crosslinker_or_chain_transfer": ("crosslinker", "monomer feed", "1", "0", "180", "crosslinker",
                                      "TODO optional crosslinker or chain-transfer agent", "TODO optional", "OPTIONAL"),
}

MOLES_GAP = ("moles_mmol needs direct moles_mmol, mass_g plus molecular_weight_g_mol, "
             "or volume_mL plus stock concentration units")
VOLUME_GAP = ("volume_mL needs mass_g plus density_g_mL, volume_mL, or moles_mmol plus "
              "molecular_weight_g_mol and density_g_mL")

MATERIAL_ADVICE = {
    "roles": "Add formulation rows for missing required material groups: ",
    "quantities": "Enter at least one quantitative basis for every formulation row: mass_g, volume_mL, moles_mmol, wt_percent, or concentration.",
    "properties": "Complete Master Reagents physical-property fields needed for calculations, especially molecular weight and density for monomers.",
    "ok": "Material role and quantitative fields are sufficient for a first-pass agent recommendation.",
    "summary_ok": "Material scaffold is complete enough for first-pass experiment planning.",
    "summary": "Material scaffold needs attention: ",
}

# ---------------------------------------------------------------------------
# Measurements of the daily log.
# structured field: (measurement type, units)
# ---------------------------------------------------------------------------
LOG_FIELDS = {
    "temperature_C": ("temperature", "C"),
    "rpm": ("agitation speed", "rpm"),
    "pH": ("pH", ""),
    "solids_percent": ("solids percent", "%"),
    "particle_size_nm": ("DLS particle size", "nm"),
    "conversion_percent": ("conversion", "%"),
    "residual_monomer_percent": ("residual monomer", "%"),
    "polydispersity_index": ("polydispersity index", ""),
    "Tg_C": ("Tg", "C"),
    "hold_time_min": ("hold time", "min"),
    "viscosity_cP": ("viscosity", "cP"),
}
# fields that count as outcome metrics when results are analysed, in order
METRIC_LOG_FIELDS = ["particle_size_nm", "conversion_percent", "residual_monomer_percent",
                     "polydispersity_index", "Tg_C", "hold_time_min", "solids_percent",
                     "viscosity_cP", "pH"]

_IS = r"\s*(?:=|:|was|at|about|~)?\s*"
_NUM = r"(\d+(?:\.\d+)?)"
_SIGNED = r"(-?\d+(?:\.\d+)?)"
_DEG_C = r"\s*(?:deg\s*C|degrees?\s*C|C\b)"
# text field: (measurement type, units, patterns tried in order; group 1 is the value)
TEXT_FIELDS = {
    "temperature_C": ("temperature", "C",
                      [r"\b(?:temp(?:erature)?|reactor temp(?:erature)?)" + _IS + _SIGNED + _DEG_C]),
    "rpm": ("agitation speed", "rpm",
            [r"\b" + _NUM + r"\s*rpm\b",
             r"\b(?:agitation|stirring|stir rate)" + _IS + _NUM + r"\s*(?:rpm)?\b"]),
    "pH": ("pH", "", [r"\bpH" + _IS + _NUM + r"\b"]),
    "solids_percent": ("solids percent", "%", [r"\b(?:solids|solids content)" + _IS + _NUM + r"\s*%"]),
    "particle_size_nm": ("DLS particle size", "nm",
                         [r"\b(?:particle size|DLS|diameter)" + _IS + _NUM + r"\s*nm\b"]),
    "conversion_percent": ("conversion", "%", [r"\b(?:conversion|conv(?:ersion)?)" + _IS + _NUM + r"\s*%"]),
    "viscosity_cP": ("viscosity", "cP",
                     [r"\b(?:viscosity|visc)" + _IS + _NUM + r"\s*(?:cP|centipoise)\b"]),
    "coagulum_mass_g": ("coagulum mass", "g",
                        [r"\b(?:coagulum|coagulate|grit)\s*(?:mass|weight)?" + _IS + _NUM + r"\s*g\b"]),
    "residual_monomer_percent": ("residual monomer", "%",
                                 [r"\b(?:residual monomer|residuals?|unreacted monomer)" + _IS + _NUM + r"\s*%"]),
    "polydispersity_index": ("polydispersity index", "",
                             [r"\b(?:PDI|polydispersity(?: index)?)" + _IS + _NUM + r"\b"]),
    "Tg_C": ("Tg", "C", [r"\b(?:Tg|glass transition(?: temperature)?)" + _IS + _SIGNED + _DEG_C]),
    "hold_time_min": ("hold time", "min",
                      [r"\b(?:hold time|held|thermal hold)\s*(?:=|:|was|for|about|~)?\s*" + _NUM + r"\s*(?:min|minutes?)\b"]),
}
STRUCTURED_METHOD = "Daily Log structured field"
TEXT_METHOD = "Daily Log observation text"

# ---------------------------------------------------------------------------
# Literature tags, stop words, ranking terms.
# ---------------------------------------------------------------------------
WORK_TAGS = {
    "surfactant": ["surfactant", "anionic", "nonionic"],
    "particle_size": ["particle size", "particles", "latex", "pdi", "polydispersity"],
    "initiator": ["initiator", "persulfate", "radical", "residual monomer", "unreacted monomer"],
    "monomer": ["monomer", "acrylate", "methacrylate"],
    "stability": ["stability", "coagulative", "coagulum", "coagulation", "colloidal"],
    "feed": ["semibatch", "semi-batch", "feed"],
}
EVIDENCE_TAGS = {
    "surfactant": ["surfactant", "sds", "anionic", "nonionic", "ionic"],
    "particle_size": ["particle size", "particles", "dls", "diameter", "nucleation", "pdi", "polydispersity"],
    "stability": ["stability", "coagulum", "coagulation", "colloidal", "latex"],
    "initiator": ["initiator", "persulfate", "radical", "aps", "residual monomer", "unreacted monomer"],
    "monomer": ["monomer", "acrylate", "methacrylate"],
    "feed": ["feed", "semibatch", "semi-batch", "starved"],
}
QUERY_STOP_WORDS = ["completed", "experiment", "record", "recorded", "run", "sample", "stage",
                    "timestamp", "temperature"]
QUERY_PRIORITY = ["emulsion", "polymerization", "surfactant", "initiator", "particle", "size",
                  "coagulum", "latex", "core", "shell", "monomer", "feed"]
QUERY_LENGTH = 18
RANKING_TERMS = ["latex", "coagulum", "coagulation", "nucleation", "surfactant", "initiator", "monomer", "feed"]
OFF_PROCESS_TERMS = ["biomedical", "biocompatibility", "nanoparticle", "photocatalysis",
                     "pickering emulsion", "pulmonary surfactant"]
CONFIDENCE = ["low", "medium", "high"]
LITERATURE_ADVICE = {
    "surfactant": "Use linked evidence to prioritize surfactant active basis or surfactant package as a controlled factor.",
    "feed": "Keep monomer feed profile explicit because linked evidence points to feed/nucleation sensitivity.",
    "initiator": "Track initiator freshness, radical flux, and chase strategy as possible process-health factors.",
    "monomer": "Keep monomer identity fixed unless the literature review explicitly supports a chemistry change.",
}

# ---------------------------------------------------------------------------
# Status sets, safety wording, planned measurement units.
# ---------------------------------------------------------------------------
OPEN_SUGGESTIONS = ["draft", "accepted", "run_planned"]
SAFETY_FAILED = ["failed", "not approved", "unsafe", "do not run", "blocked"]
SAFETY_APPROVED = ["approved", "safety review complete", "safety review completed",
                   "safety review passed", "sds reviewed", "sop reviewed"]
PLANNED_UNITS = {
    "particle_size_nm": "nm",
    "polydispersity_index": "",
    "solids_percent": "%",
    "conversion_percent": "%",
    "residual_monomer_percent": "%",
    "coagulum_mass_g": "g",
    "pH": "",
    "viscosity_cP": "cP",
    "Tg_C": "C",
    "hold_time_min": "min",
}
PLANNED_RESULTS = ["particle_size_nm", "polydispersity_index", "solids_percent", "conversion_percent",
                   "residual_monomer_percent", "coagulum_mass_g", "pH", "viscosity_cP"]
PLAN_MEASUREMENTS = ["particle_size_nm", "polydispersity_index", "solids_percent", "conversion_percent",
                     "residual_monomer_percent", "coagulum_mass_g", "pH", "temperature_C",
                     "viscosity_cP", "observation"]

NO_MEASUREMENTS = "Add normalized Results rows before asking the agent to interpret the experiment outcome."
NO_TARGETS = "No process-specific target profile is available; interpret measurements manually and isolate one variable in the next run."
QUALITATIVE_COAGULUM = "Qualitative coagulum or instability was recorded; treat stability as a gating criterion even if no coagulum mass was measured."
IN_TARGET = "Measured outcomes are within the first-pass target profile; use this run as a candidate control before expanding variables."
HISTORY_CONTROL = "Use same-process prior experiments as controls when choosing the next variable to isolate."

# ---------------------------------------------------------------------------
# Preflight checks.
# check: (message if it passes, message if not, action)
# ---------------------------------------------------------------------------
CHECKS = {
    "experiment_required_fields": (
        "Experiment row has the required planning fields.",
        "Experiment row is missing required fields.",
        "Fill Experiments."),
    "material_roles": (
        "Required process material roles are present.",
        "Required process material roles are missing.",
        "Run scaffold-materials or add Formulations rows for: "),
    "formulation_quantities": (
        "Every formulation row has a quantitative basis.",
        "One or more formulation rows lacks a quantitative basis.",
        "Fill at least one of mass_g, volume_mL, moles_mmol, wt_percent, or concentration for each Formulations row."),
    "reagent_properties": (
        "Master Reagents has the physical-property fields needed for the current roles.",
        "Master Reagents is missing physical-property fields needed for calculations.",
        "Fill missing Master Reagents fields such as molecular_weight_g_mol, density_g_mL, or concentration."),
    "reagent_safety": (
        "Master Reagents has hazards/SDS review notes for the formulation reagents.",
        "Master Reagents is missing hazards/SDS review notes for one or more formulation reagents.",
        "Fill Master Reagents.hazards with SDS-reviewed handling notes before running or accepting the follow-up."),
    "placeholder_reagents": (
        "No generated placeholder reagents are linked to this formulation.",
        "Generated placeholder reagent rows must be replaced before running.",
        "Replace TODO/AUTO reagent identities with verified Master Reagents rows and SDS-reviewed hazards."),
    "daily_log_observations": (
        "Daily Log has observations for this experiment.",
        "Daily Log has no observations for this experiment.",
        "Capture timestamped observations in Daily Log during setup, feed, hold, workup, and testing."),
    "results_measurements": (
        "Results has measurements for this experiment.",
        "Results has no measurements for this experiment.",
        "Capture normalized measurements in Results before asking for a result-driven next experiment."),
    "literature_evidence": (
        "Literature Evidence rows are linked to this experiment.",
        "No Literature Evidence rows are linked yet.",
        "Link or import literature evidence to ground suggestions."),
    "open_suggestions": (
        "No open Agent Suggestions currently block a new suggestion run.",
        "Open Agent Suggestions exist for this experiment.",
        "Review open suggestions and set status to rejected or run_complete before rerunning without --force."),
}
PREFLIGHT_READY = "Experiment notebook row is ready for the selected preflight stage."
MISSING_ROW_ACTION = "Add an Experiments row with this experiment_id before scaffolding or review."
