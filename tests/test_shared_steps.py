"""Steps that many queries share: what they give, and that they are done once and where the rows are."""

import pytest

from assayframe.operators import formulation, results
from assayframe.plans import daily_run, recommend
from assayframe.session import cut
from tests.test_scores import cosines


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lab(tables):
    return (
        tables.fill("reagents", [
            {"reagent_id": "R1", "name": "grit-free soap", "molecular_weight_g_mol": "1,000", "density_g_mL": "2", "purity_fraction": "50%"},
            {"reagent_id": "R1", "name": "soap", "molecular_weight_g_mol": "100", "density_g_mL": "0.5", "purity_fraction": "80%"},
            {"reagent_id": "R2", "name": "stock", "concentration": "10", "concentration_units": "mg/mL"}])
        .fill("experiments", [
            {"experiment_id": "E1", "process_type": "emulsion polymerization", "objective": "Avoid a Precipitate", "date": "2024-01-01", "status": "planned"},
            {"experiment_id": "E2", "process_type": "bulk", "objective": "latex feed", "date": "2024-01-01", "status": "planned"}])
        .fill("formulations", [
            {"experiment_id": "E1", "reagent_id": "R1", "target_role": "core_monomer", "mass_g": "10"},
            {"experiment_id": "E1", "reagent_id": "R2", "target_role": "surfactant", "volume_mL": "4"},
            {"experiment_id": "E2", "reagent_id": "R9", "target_role": "core_monomer", "notes": "Coagulated"}])
        .fill("daily_log", [
            {"experiment_id": "E1", "issue_tags": " Broad_PSD ,, ", "particle_size_nm": "351", "conversion_percent": "85"},
            {"experiment_id": "E2", "observation": "LOW conversion", "particle_size_nm": "x", "conversion_percent": "84"},
            {"experiment_id": "E3", "observation": "grit"}])
        .fill("results", [
            {"experiment_id": "E2", "measurement_type": "Residual monomer", "value": "1.5"},
            {"experiment_id": "E1", "measurement_type": "PDI", "value": "n/a"}]))


def test_reagent_cells_are_parsed_once(tables):
    t = lab(tables)
    rows = {(r.experiment_id, r.reagent_id): r for r in formulation.formulation_quantities(t).collect()}
    one, two, none = rows["E1", "R1"], rows["E1", "R2"], rows["E2", "R9"]
    assert (one.derived_volume_mL, one.derived_moles_mmol, one.derived_active_mass_g) == (20.0, 80.0, 8.0)
    assert (two.derived_active_mass_g, two.missing_for_calculations != [], len(none.missing_for_calculations)) == (0.04, True, 2)
    assert not [c for c in formulation.formulation_quantities(t).columns if c.startswith("__")]
    # updates and totals do not make the list of what is missing
    assert "lambdafunction" not in plan(formulation.formulation_updates(t))


def test_entry_signals(tables):
    t = lab(tables)
    got = results.entry_signals(t)
    assert {(r.experiment_id, r.signal) for r in got.collect()} == {
        ("E1", "instability"), ("E1", "broad_psd"), ("E1", "particle_size_high"),
        ("E2", "coagulum"), ("E2", "low_conversion"), ("E2", "residual_monomer_high")}
    # only the texts of reagents are read by lists cleaned of nulls (in a filter and in what it lets through)
    assert plan(got).count("lambdafunction") <= 2


@pytest.mark.parametrize("held", [0, 100_000])
def test_entry_knowledge(tables, monkeypatch, held):
    monkeypatch.setattr(daily_run, "QUERY_TOKENS", held)
    t = lab(tables).fill("knowledge", [
        {"process_type": "emulsion polymerization", "guidance": "precipitate soap"}, {"process_type": "bulk", "guidance": "latex feed feed"},
        {"process_type": "bulk", "guidance": "latex feed feed"}])
    asked = {e: " ".join(r.text for r in daily_run.literature.entry_texts(t).where(f"experiment_id = '{e}'").collect()) for e in ("E1", "E2")}
    cols = daily_run.TABLES["knowledge"].columns
    docs = {r.row_key: " ".join(f"{c} {r[c]}" for c in cols) for r in t["knowledge"].collect()}
    want = {}
    for e, s in asked.items():
        best = sorted((-round(x, 9), d) for d, x in cosines(docs, s).items() if x > 0)[:2]
        want |= {(e, i): (round(-x, 4), t["knowledge"].where(f"row_key = '{d}'").first().guidance) for i, (x, d) in enumerate(best, 1)}
    got = {(r.experiment_id, r["rank"]): (r.score, r.summary) for r in daily_run.entry_knowledge(t, 2).collect()}
    assert got == want


def test_sides_of_a_recommendation_are_tables(tables, spark):
    t = lab(tables)
    evidence = spark.createDataFrame([("E1", 1, "L1", ["feed"])], "experiment_id string, rank int, evidence_id string, tags array<string>")
    context = recommend.literature_context(evidence, evidence["tags"])
    rec = recommend.recommendations(t, cut(results.experiment_signals(t)), context)
    assert {r.experiment_id: (r.focus, r.confidence, r.linked_evidence_ids) for r in rec.collect()} == {
        "E1": ("stability", "medium", "L1"), "E2": ("generic", "medium", "")}
    # the first row of each experiment is all that is still worked out in this plan
    assert plan(rec).count("Aggregate") <= 1
