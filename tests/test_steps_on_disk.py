"""What steps leave on disk, and work that is done once for many rows."""

import time

from pyspark.sql import functions as F

from assayframe import catalog
from assayframe.operators import change_set, changes, literature
from assayframe.session import cut
from assayframe.sources import tables as sources


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in blocks.mkString("\n").split("\n") if "shuffle_" in f}


def test_shuffles_go_with_their_step(spark):
    before = shuffle_files(spark)
    cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):  # files are removed behind the step, not in it
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_same_links_are_weighed_once(spark, monkeypatch):
    links = {"E1": ["L1", "L2"], "E2": ["L2", "L1"], "E3": ["L1"], "E4": ["L1", "L2"], "E5": ["L3"]}
    links = spark.createDataFrame([(e, d) for e, ds in links.items() for d in ds], "experiment_id string, doc_id string")
    docs = spark.createDataFrame([("L1", "latex feed", ["latex"]), ("L2", "feed water", []), ("L3", "soap", ["soap"])], "doc_id string, text string, terms array<string>")
    pieces = spark.createDataFrame([(f"E{i}", "latex soap :latex") for i in range(1, 6)], "experiment_id string, text string")
    assert {(r.experiment_id, r.docs, r.group) for r in literature.same_links(links).collect()} == {
        ("E1", 2, "E1"), ("E2", 2, "E1"), ("E4", 2, "E1"), ("E3", 1, "E3"), ("E5", 1, "E5")}
    made, plain = [], literature.group_weights
    monkeypatch.setattr(literature, "group_weights", lambda *a: made.append(plain(*a)) or made[-1])
    got = {(r.experiment_id, r.doc_id): (round(r.score, 9), r.shared) for r in literature.group_scores(links, docs, pieces, True).collect()}
    assert len(got) == 8 and got["E1", "L1"] == got["E2", "L1"] == got["E4", "L1"] and got["E1", "L1"][1] == 1 and got["E5", "L3"][1] == 1
    # a row of length for each link of a group, not of an experiment
    assert made[0].where("token is null").count() == 4


def test_pieces_of_asked_experiments(tables):
    tables.fill("experiments", [{"experiment_id": f"E{i}", "objective": "latex"} for i in range(3)])
    tables.fill("reagents", [{"reagent_id": "R1", "name": "soap"}])
    tables.fill("formulations", [{"experiment_id": f"E{i}", "reagent_id": r} for i in range(3) for r in ("R1", "R9")])
    keep = tables["experiments"].where("experiment_id = 'E1'").select("experiment_id")
    got = literature.entry_pieces(tables, keep, gained=lambda c: F.upper(c)).collect()
    assert sorted((r.experiment_id, r.section, "SOAP" in (r.gained or "")) for r in got) == [("E1", 0, False), ("E1", 3, False), ("E1", 3, True)]
    # with a place, pieces behind it are left out
    enough = keep.withColumn("enough", F.struct(F.lit(3).alias("section"), F.lit("000002").alias("row_key")))
    assert [(r.section, r.row_key) for r in literature.entry_pieces(tables, enough).orderBy("section").collect()] == [(0, "000001"), (3, "000002")]


def test_written_steps_of_updates(tables, spark):
    tables.fill("reagents", [{"reagent_id": "R1", "name": "a"}, {"reagent_id": "R1", "name": "b"}, {"reagent_id": "R2"}])
    up = spark.createDataFrame([("R1", "name", "x"), ("R9", "name", "y")], "reagent_id string, field string, value string")
    after = changes.apply_updates(tables["reagents"], up, ["reagent_id"], written=True)
    assert "Aggregate" not in plan(after) and [r.name for r in after.orderBy("row_key").collect()] == ["x", "b", ""]
    folded, rest = changes.fold_updates(tables["reagents"], up, ["reagent_id"])
    assert [r.name for r in folded.orderBy("row_key").collect()] == ["x", "x", ""] and [r.value for r in rest.collect()] == ["y"]
    log = change_set.change_set({"reagents": tables["reagents"]}, {"reagents": up.withColumn("seq", F.lit("1"))}, "r")
    errors = change_set.audit(log, tables)
    assert "Join" not in plan(errors)
    assert sorted((r.code, r.key) for r in errors.collect()) == [
        ("duplicate_append", "R1"), ("duplicate_append", "R1"), ("duplicate_append", "R2"), ("duplicate_in_batch", "R1"), ("missing_update_target", "R9")]


def test_signals_of_planned_rows_are_made_once(tables, monkeypatch):
    tables.fill("experiments", [{"experiment_id": "E1", "process_type": "emulsion polymerization"}])
    tables.fill("formulations", [{"experiment_id": "E1", "reagent_id": "R1", "target_role": "surfactant", "mass_g": "2"}])
    tables.fill("daily_log", [{"experiment_id": "E1", "particle_size_nm": "400"}])
    monkeypatch.setattr(catalog, "notebook", lambda spark, sf_dir: tables)
    got = catalog.QUERIES["plan_rows"](tables["experiments"].sparkSession, "")
    assert [(r.experiment_id, r.mass_g) for r in got.collect()] == [("E1-FUP-001", "2.3")]
    # neither log rows nor results are read again
    assert "particle_size_nm" not in plan(got)


def test_snapshot_parts_can_be_compressed(tables, spark, tmp_path):
    tables.fill("config", [{"key": f"k{i}", "value": "v"} for i in range(12)])
    sources.write_snapshot(tables, f"{tmp_path}/s", 5, compression="gzip")
    assert {f.suffix for f in (tmp_path / "s" / "parts").glob("*/part-*")} == {".gz"}
    back = sources.tables_from_snapshot(sources.read_parts(spark, f"{tmp_path}/s"))["config"]
    assert [r.key for r in back.orderBy("row_key").collect()] == [f"k{i}" for i in range(12)]
    assert sources.snapshot_gaps(spark, f"{tmp_path}/s").count() == 0
