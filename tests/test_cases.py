"""Literal cases with known results, hot keys, idempotence."""

import pytest
from pyspark.sql import functions as F

from assayframe.functions import text
from assayframe.operators import audit, changes, followup, formulation, history, literature, log_results, materials, results, search, select
from assayframe.plans import agent, materialize


def derive(tables, row, reagent):
    tables.fill("formulations", [{"experiment_id": "E", "reagent_id": "R", "target_role": "core_monomer", **row}])
    tables.fill("reagents", [{"reagent_id": "R", **reagent}])
    return formulation.formulation_quantities(tables).first()


@pytest.mark.parametrize("row, reagent, want", [
    ({"volume_mL": "2.0"}, {"density_g_mL": "1.05", "molecular_weight_g_mol": "156.18"}, {"mass_g": 2.1, "moles_mmol": 13.446024}),
    ({"mass_g": "10"}, {"molecular_weight_g_mol": "100", "density_g_mL": "1.25", "purity_fraction": "0.8"},
     {"active_mass_g": 8.0, "moles_mmol": 80.0, "volume_mL": 8.0}),
    ({"moles_mmol": "80"}, {"molecular_weight_g_mol": "100", "density_g_mL": "1.25", "purity_fraction": "80%"},
     {"active_mass_g": 8.0, "mass_g": 10.0, "volume_mL": 8.0}),
    ({"volume_mL": "2.5"}, {"concentration": "0.1", "concentration_units": "M"}, {"moles_mmol": 0.25}),
    ({"volume_mL": "2.0"}, {"concentration": "10", "concentration_units": "mg/mL", "molecular_weight_g_mol": "288.38"},
     {"active_mass_g": 0.02, "moles_mmol": 0.069353, "mass_g": None}),
])
def test_derived_quantities(tables, row, reagent, want):
    got = derive(tables, row, reagent)
    for field, value in want.items():
        x = got[f"derived_{field}"]
        assert x == value if value is None else x == pytest.approx(value, abs=1e-6)


def test_weight_percent_and_cells(tables):
    tables.fill("formulations", [
        {"experiment_id": "E", "reagent_id": f"R{i}", "target_role": "buffer", "mass_g": m} for i, m in enumerate(["10", "0.2", "89.8"])])
    got = {(r.reagent_id, r.field): r.value for r in formulation.formulation_updates(tables).collect()}
    assert got == {("R0", "wt_percent"): "10", ("R1", "wt_percent"): "0.2", ("R2", "wt_percent"): "89.8"}


def test_log_text(tables):
    tables.fill("daily_log", [
        {"experiment_id": "E", "timestamp": "2026-06-09T16:00:00", "process_stage": "test", "particle_size_nm": "510",
         "observation": "DLS 510 nm after workup; conversion 76%; pH 5.8; solids 39%; viscosity 120 cP; coagulum mass 0.4 g."},
        {"experiment_id": "P", "timestamp": "2026-06-09T18:30:00",
         "observation": "Residual monomer 1.8%; PDI 0.12; Tg -18 C; thermal hold for 45 min."}])
    got = {(r.experiment_id, r.measurement_type): (r.value, r.method) for r in log_results.daily_log_results(tables).collect()}
    assert len(got) == 10
    assert got[("E", "DLS particle size")] == ("510", "Daily Log structured field")
    assert got[("E", "coagulum mass")][0] == "0.4"
    assert [got[("P", m)][0] for m in ("residual monomer", "polydispersity index", "Tg", "hold time")] == ["1.8", "0.12", "-18", "45"]


def test_greedy_order_matches_a_walk(spark):
    """Keys that repeat across each other: the parallel rounds give what a reader walking the rows would keep."""
    import random

    rnd = random.Random(3)
    rows = [(f"{i:05d}", i % 3, f"s{rnd.randrange(12)}", f"v{rnd.randrange(12)}") for i in range(120)]
    seen_l, seen_r, want = set(), set(), []
    for k, p, a, b in rows:
        if a in seen_l or b in seen_r:
            continue
        seen_l.add(a)
        seen_r.add(b)
        want.append(k)
    df = spark.createDataFrame(rows, "row_key string, field_pos int, a string, b string")
    got = log_results.accept_in_order(df, ["a"], ["b"], ["row_key", "field_pos"])
    assert sorted(r.row_key for r in got.collect()) == want


def test_taken_keys_are_dropped_in_the_rounds(spark):
    """Taken keys count as kept before the first row; a row behind a dropped one comes up; rows alike are kept both."""
    rows = [("1", "a", "x"), ("2", "a", "y"), ("3", "b", "y"), ("4", "c", "z"), ("4", "c", "z"), (None, "d", "w"), ("6", None, "q")]
    df = spark.createDataFrame(rows, "row_key string, a string, b string")
    taken = spark.createDataFrame([("x",), ("x",), ("none",)], "b string")
    got = log_results.accept_in_order(df, ["a"], ["b"], ["row_key"], None, taken)
    assert sorted((r.row_key or "", r.a) for r in got.collect()) == [("", "d"), ("2", "a"), ("4", "c"), ("4", "c")]
    none = log_results.accept_in_order(df, ["a"], ["b"], ["row_key"], spark.createDataFrame([("a",), ("d",)], "a string"), None)
    assert sorted(r.row_key for r in none.collect()) == ["3", "4", "4"]


def test_recorded_keys_of_log_samples(tables):
    """Only sample ids made as the log makes them, and types and units of the log, can be in its way."""
    tables.fill("results", [
        {"experiment_id": " E", "sample_id": "E-DL-t1-pH ", "measurement_type": "pH", "value": " 7 ", "units": ""},
        {"experiment_id": "E", "sample_id": "F-DL-t1-pH", "measurement_type": "PH", "value": "8", "units": "x"}])
    samples, values = log_results.recorded_keys(tables["results"])
    kind = [f for f, _, _ in log_results.KINDS].index("pH")
    assert [tuple(r) for r in samples.collect()] == [("E", "t1", kind)] and [tuple(r) for r in values.collect()] == [("E", kind, "7")]


def test_rerun_adds_nothing(tables):
    tables.fill("daily_log", [{"experiment_id": "E", "timestamp": "t1", "pH": "7", "observation": "conversion 50%"}])
    first = log_results.daily_log_results(tables)
    tables["results"] = changes.append_rows(tables["results"], first, "results")
    assert log_results.daily_log_results(tables).count() == 0


def test_result_analysis(tables):
    tables.fill("experiments", [{"experiment_id": "E", "process_type": "emulsion polymerization"}])
    tables.fill("results", [
        {"experiment_id": "E", "sample_id": "1", "measurement_type": "DLS particle size", "value": "420", "units": "nm"},
        {"experiment_id": "E", "sample_id": "2", "measurement_type": "conversion", "value": "72", "units": "%"}])
    r = results.result_analysis(tables).first()
    assert r.signals == ["low_conversion", "particle_size_high"] and r.limiting_count == 2
    assert r.summary == "Outcome limits: conversion 72 % is below_target; particle_size 420 nm is above_target."


def test_metric_key_false_positives(spark):
    from assayframe.functions.metrics import metric_key

    df = spark.createDataFrame([("phase check", ""), ("outgassing", "")], "m string, u string")
    assert [r[0] for r in df.select(metric_key(F.col("m"), F.col("u"))).collect()] == ["pH", "Tg" if "tg" in "outgassing " else ""]


def test_date_selection(tables):
    tables.fill("experiments", [
        {"experiment_id": "EP-001", "date": "2026-06-09", "status": "planned"}, {"experiment_id": "EP-002", "date": "2026-06-01", "status": "planned"},
        {"experiment_id": "EP-003", "date": "2026-06-01", "status": "running"}, {"experiment_id": "EP-004", "date": "2026-06-09", "status": "abandoned"}])
    tables.fill("daily_log", [{"experiment_id": e, "timestamp": "2026-06-09T10:00:00", "observation": "x"} for e in ("EP-003", "EP-004")])
    got = select.select_experiments(tables, date="2026-06-09")
    assert sorted(r.experiment_id for r in got.collect()) == ["EP-001", "EP-003"]


def test_history_leaves_out_the_run_itself(tables):
    tables.fill("experiments", [
        {"experiment_id": f"E{i}", "date": f"2026-01-0{i}", "process_type": "emulsion polymerization", "status": "complete"} for i in range(1, 5)])
    tables.fill("results", [
        {"experiment_id": f"E{i}", "measurement_type": "DLS particle size", "value": str(100 * i), "units": "nm"} for i in range(1, 5)])
    got = {r.experiment_id: (r["count"], r.min, r.min_experiment_id) for r in history.history_benchmarks(tables, 2).collect()}
    assert got == {"E1": (2, "300", "E3"), "E2": (2, "300", "E3"), "E3": (2, "200", "E2"), "E4": (2, "200", "E2")}
    assert history.history_benchmarks(tables, 0).count() == 0


def test_next_followup(tables):
    tables.fill("experiments", [{"experiment_id": e} for e in ("EP-001", "EP-001-FUP-001", "EP-001-FUP-003")])
    tables.fill("suggestions", [
        {"suggestion_id": "1", "experiment_id": "EP-001", "proposed_experiment_id": "EP-001-FUP-002"},
        {"suggestion_id": "2", "experiment_id": "EP-001", "proposed_plan_json": '{"suggested_experiment_id": "EP-001-FUP-004"}'}])
    got = {r.experiment_id: r.suggested_experiment_id for r in followup.next_followup_ids(tables).collect()}
    assert got["EP-001"] == "EP-001-FUP-005"


def test_prefix_links_reach_every_owner(tables):
    tables.fill("experiments", [{"experiment_id": "EP-001"}, {"experiment_id": "EP-001-FUP-001"}])
    tables.fill("evidence", [{"evidence_id": "LIT-EP-001-FUP-001-001", "finding": "x"}])
    got = {r.experiment_id for r in literature.evidence_links(tables).collect()}
    assert got == {"EP-001", "EP-001-FUP-001"}


def test_work_ranking(spark):
    works = spark.createDataFrame([
        ("0", "Non-Ionic Surfactants for Stabilization of Polymeric Nanoparticles for Biomedical Uses", "2021", "999",
         ["Pulmonary surfactant", "Nanoparticle", "Emulsion", "Biocompatibility"]),
        ("1", "Coagulative nucleation and particle size distributions in emulsion polymerization", "1984", "194",
         ["Emulsion polymerization", "Particle size", "Nucleation"]),
        ("2", "Emulsion polymerization: From fundamental mechanisms to process developments", "2004", "323",
         ["Emulsion polymerization", "Polymer chemistry", "Latex stability"])],
        "row_key string, title string, year string, cited_by_count string, concepts array<string>")
    for c in ("work_id", "primary_id", "source", "publication_date", "doi", "url", "journal_or_collection", "abstract", "summary"):
        works = works.withColumn(c, F.lit(""))
    works = works.withColumn("authors", F.array().cast("array<string>"))
    q = spark.createDataFrame([("EP-010", "emulsion polymerization surfactant particle size coagulum latex feed")], "query_id string, text string")
    rows = literature.evidence_rows(works, q, 2).orderBy("evidence_id").collect()
    assert [r.title[:10] for r in rows] == ["Coagulativ", "Emulsion p"]
    assert rows[0].evidence_id == "LIT-EP-010-001" and rows[0].confidence == "high"
    assert "stability" in rows[0].relevance_tags and "feed" not in rows[0].relevance_tags


def test_scaffold_of_an_empty_notebook(tables):
    tables.fill("experiments", [{"experiment_id": "EP-NEW", "process_type": "emulsion polymerization"}])
    s = materials.material_scaffold(tables)
    assert {r.target_role for r in s.collect()} == {"core_monomer", "initiator", "surfactant", "solvent"}
    notes = {r.reagent_id: r.notes for r in materials.placeholder_reagents(s, tables["reagents"]).collect()}
    assert "acrylate monomer" in notes["AUTO-EP-NEW-MONOMER"] and len(notes) == 4


def test_reagent_upsert(tables):
    tables.fill("reagents", [{"reagent_id": "R", "name": "old", "category": "buffer"}])
    new = tables.__class__.fill(tables, "reagents", [{"reagent_id": "R", "name": "old", "category": "buffer"}])["reagents"]
    merged = new.withColumn("density_g_mL", F.lit("1.1")).withColumn("name", F.lit("new"))
    got = {r.field: r.action for r in changes.reagent_reconcile(changes.reagent_merge(merged), tables["reagents"]).collect()}
    assert got == {"name": "conflict", "category": "same", "density_g_mL": "fill"}


def test_safety_words(spark):
    df = spark.createDataFrame([("",), ("Not approved",), ("SDS reviewed",), ("check SDS",)], "s string")
    assert [r[0] for r in df.select(agent.safety_class(F.col("s"))).collect()] == ["missing", "failed", "approved", "reminder"]


def test_materialisation_counts_and_rerun(tables):
    tables.fill("suggestions", [{"suggestion_id": "S", "experiment_id": "E", "status": "accepted", "proposed_plan_json":
        '{"suggested_experiment_id": "E-FUP-001", "sheet_rows": {"experiments": [{"objective": "o"}], "formulations": '
        '[{"reagent_id": "R", "target_role": "buffer", "mass_g": "1"}], "results_to_capture": [{"measurement_type": "pH"}]}}'},
        {"suggestion_id": "B", "experiment_id": "E", "status": "accepted", "proposed_plan_json": "{bad"}])
    m = materialize.materialize(tables, "2026-07-01")
    assert [m[n].count() for n in ("experiments", "formulations", "results")] == [1, 1, 1]
    assert {r.suggestion_id: r.skip_reason for r in m["runs"].collect()} == {"S": "", "B": "missing_proposed_plan_json"}
    for n in ("experiments", "formulations", "results"):
        tables[n] = changes.append_rows(tables[n], m[n], n)
    again = materialize.materialize(tables, "2026-07-01")
    assert {r.suggestion_id: r.skip_reason for r in again["runs"].collect()}["S"] == "planned_rows_already_exist"


def test_update_touches_first_row_only(tables):
    tables.fill("reagents", [{"reagent_id": "R", "name": ""}, {"reagent_id": "R", "name": ""}])
    up = tables["reagents"].sparkSession.createDataFrame([("R", "name", "n"), ("R", "nope", "x")], "reagent_id string, field string, value string")
    got = changes.apply_updates(tables["reagents"], up, ["reagent_id"]).orderBy("row_key").collect()
    assert [r.name for r in got] == ["n", ""]


def test_hot_key_join_is_split(spark):
    """A third of the rows on one key: the lookup splits that key at run time and stays whole."""
    from assayframe.functions.joins import lookup

    old = {k: spark.conf.get(k) for k in (
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "50k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        n = 200_000
        left = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        right = left.groupBy("k").agg(F.count("*").alias("n"))
        df = lookup(left, right, ["k"])
        out = df.groupBy().agg(F.count("*").alias("rows"), F.max("n").alias("hot"), F.max("pad").alias("pad"))
        assert tuple(out.collect()[0])[:2] == (n, n // 3 + 1)
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_search_against_brute_force(spark):
    import math
    import re

    docs = [("a", "latex feed latex"), ("b", "monomer feed"), ("c", "water")]
    qs = [("q", "latex monomer unknown")]
    tok = lambda s: [w.lower() for w in re.findall(r"[a-zA-Z][a-zA-Z0-9_\-]+", s)]
    df = {}
    for _, s in docs:
        for w in set(tok(s)):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log((len(docs) + 1) / (df[w] + 1)) + 1 if w in df else 1.0
    vec = lambda s: {w: tok(s).count(w) / len(tok(s)) * idf(w) for w in tok(s)}
    cos = lambda x, y: sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    want = {d: round(cos(vec(qs[0][1]), vec(s)), 4) for d, s in docs if cos(vec(qs[0][1]), vec(s)) > 0}
    got = search.tfidf_search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(qs, "query_id string, text string"), 5)
    assert {r.doc_id: r.score for r in got.collect()} == want


def test_snapshot_and_validation(spark, tmp_path):
    import json

    from assayframe.contract import TABLES
    from assayframe.sources.tables import read_snapshot, tables_from_snapshot, validate_snapshot

    header = list(TABLES["config"].columns)
    snap = {"sheets": {"Agent Config": {"sheet_id": 1, "values": [header, ["k", " v "], ["", "", ""], ["short"]]}, "Odd": {"sheet_id": 2, "values": [["x"]]}}}
    (tmp_path / "s.json").write_text(json.dumps(snap))
    s = read_snapshot(spark, str(tmp_path / "s.json"))
    rows = tables_from_snapshot(s)["config"].orderBy("row_key").collect()
    assert [(r.key, r.value, r.notes) for r in rows] == [("k", "v", ""), ("short", "", "")]
    heads = s.select(F.explode("sheets").alias("title", "sheet")).select("title", F.get("sheet.values", F.lit(0)).alias("header"))
    codes = {(r.code, r.title) for r in validate_snapshot(heads).collect()}
    assert ("unknown_sheet", "Odd") in codes and ("missing_sheet", "Results") in codes and ("header_mismatch", "Agent Config") not in codes


def test_a_table_that_compresses_well_is_not_broadcast(spark):
    """Equal rows of a written table take next to nothing in its file and a lot in the driver."""
    from assayframe.session import cut

    n = 400_000
    rows = cut(spark.range(0, n, 1, 4).select(F.col("id").alias("k"), F.repeat(F.lit("latex "), 20).alias("pad")).repartition(4))
    out = spark.range(0, n, 2, 4).withColumnRenamed("id", "k").join(rows, "k").groupBy().agg(F.count("*").alias("n"), F.max("pad").alias("pad"))
    assert out.collect()[0].n == n // 2
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_shuffle_stay_small(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"


def test_updates_are_computed_once(tables):
    spark = tables["reagents"].sparkSession
    tables.fill("reagents", [{"reagent_id": "R", "name": ""}, {"reagent_id": "R", "name": ""}, {"reagent_id": "S", "name": "s"}])
    up = spark.range(5).select(F.lit("R").alias("reagent_id"), F.lit("name").alias("field"), F.col("id").cast("string").alias("value"), F.col("id").alias("seq"))
    got = changes.apply_updates(tables["reagents"], up, ["reagent_id"])
    assert [r.name for r in got.orderBy("row_key").collect()] == ["4", "", "s"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 5") == 1


def test_query_terms_against_a_walk(tables):
    """Short and long pieces, repeated places, priority terms behind the piece that fills a query."""
    import random
    import re

    from assayframe.rules import QUERY_LENGTH, QUERY_PRIORITY

    rng = random.Random(5)
    pieces = [(f"E{rng.randrange(6)}", f"{rng.randrange(12):03d}", " ".join(
        [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(3))}" for _ in range(rng.choice([3, 5, 60]))] + rng.sample(QUERY_PRIORITY, rng.randrange(3)))) for _ in range(80)]
    pieces = list({(e, k): (e, k, x) for e, k, x in pieces}.values())
    tables.fill("experiments", [{"experiment_id": f"E{i}", "objective": "alpha beta"} for i in range(6)])
    frame = tables["experiments"].sparkSession.createDataFrame(pieces + pieces[:9], "experiment_id string, rank_key string, text string")
    got = {r.experiment_id: r.text.split() for r in literature.build_queries(tables, knowledge=frame).collect()}
    for e in got:
        seen = ["alpha", "beta"]
        for _, _, x in sorted(p for p in pieces if p[0] == e):
            seen += re.findall(r"[a-z][a-z0-9\-]+", x)
        seen = list(dict.fromkeys(w for w in seen if len(w) > 2))
        want = [w for w in QUERY_PRIORITY if w in seen] + [w for w in seen if w not in QUERY_PRIORITY]
        assert got[e] == want[:QUERY_LENGTH]
    assert len(got) == 6
