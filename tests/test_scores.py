"""Scores that are added up in parts: the same whatever the parts, and as by brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayframe.operators import literature, search


def tokens(s):
    return Counter(w.lower() for w in re.findall(r"[a-zA-Z][a-zA-Z0-9_\-]+", s))


def cosines(docs, asked):
    """Cosine of each document with the asked text by the rules of the search."""
    counts = {d: tokens(s) for d, s in docs.items()}
    df = Counter(w for c in counts.values() for w in c)
    idf = lambda w: math.log((len(docs) + 1) / (df[w] + 1)) + 1 if w in df else 1.0
    vec = lambda c: {w: n * idf(w) for w, n in c.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = vec(tokens(asked))
    return {d: sum(x * q.get(w, 0.0) for w, x in vec(c).items()) / length(vec(c)) / length(q) for d, c in counts.items()}


@pytest.mark.parametrize("docs_a_part", [1, 4096])
def test_group_scores_by_parts(spark, monkeypatch, docs_a_part):
    monkeypatch.setattr(literature, "GROUP_DOCS", docs_a_part)
    texts = {"L1": "latex feed latex", "L2": "monomer feed", "L3": "water only"}
    links = {"E1": ["L1", "L2", "L3"], "E2": ["L1"], "E3": ["L3"]}
    asked = {"E1": ["latex monomer", "unknown latex"], "E2": ["feed"], "E3": ["latex"]}
    got = literature.group_scores(
        spark.createDataFrame([(e, d) for e, ds in links.items() for d in ds], "experiment_id string, doc_id string"),
        spark.createDataFrame([(d, s, s.split()[:2]) for d, s in texts.items()], "doc_id string, text string, terms array<string>"),
        spark.createDataFrame([(e, s) for e, ss in asked.items() for s in ss], "experiment_id string, text string"), with_terms=True).collect()
    want = {(e, d): x for e, ds in links.items() for d, x in cosines({d: texts[d] for d in ds}, " ".join(asked[e])).items()}
    assert {(r.experiment_id, r.doc_id): round(r.score, 9) for r in got} == {k: round(x, 9) for k, x in want.items()}
    assert {(r.experiment_id, r.doc_id): r.shared for r in got} == {
        (e, d): len(set(texts[d].split()[:2]) & set(" ".join(asked[e]).split())) for e, ds in links.items() for d in ds}


def test_evidence_is_tokenised_once(spark, tables, monkeypatch):
    tables.fill("experiments", [{"experiment_id": f"E{i}", "objective": "latex feed", "linked_literature_ids": "L1,L2"} for i in range(5)])
    tables.fill("evidence", [{"evidence_id": "L1", "finding": "latex feed"}, {"evidence_id": "L2", "finding": "feed water"}])
    seen = []
    plain = literature.term_counts
    monkeypatch.setattr(literature, "term_counts", lambda docs, doc, *a: seen.append(docs.count()) or plain(docs, doc, *a))
    linked = literature.linked_evidence(tables)
    got = literature.evidence_matches(tables, literature.build_queries(tables, linked), linked)
    assert got.count() == 10 and seen == [2]


@pytest.mark.parametrize("held, frequent", [(100_000, 1 << 15), (100_000, 1), (0, 1 << 15)])
def test_scores_by_parts(spark, monkeypatch, held, frequent):
    monkeypatch.setattr(search, "QUERY_TOKENS", held)
    monkeypatch.setattr(search, "FREQUENT", frequent)
    monkeypatch.setattr(search, "TASK_PAIRS", 2)
    docs = {"a": "latex feed latex", "b": "monomer feed", "c": "water", "d": "feed water feed"}
    qs = {"q1": "latex monomer unknown", "q2": "feed", "q3": "nothing here"}
    got = search.score(spark.createDataFrame(list(docs.items()), "doc_id string, text string"), spark.createDataFrame(list(qs.items()), "query_id string, text string"))
    want = {(q, d): round(x, 9) for q, s in qs.items() for d, x in cosines(docs, s).items() if x > 0}
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in got.collect()} == want


def test_pairs_are_not_shuffled(spark):
    docs = spark.createDataFrame([(f"d{i}", f"latex w{i}") for i in range(20)], "doc_id string, text string")
    plan = search.score(docs, spark.createDataFrame([("q", "latex")], "query_id string, text string"))._jdf.queryExecution().executedPlan().toString()
    # the sums over pairs stand on the rows as placed by document
    assert "Exchange" not in plan[:plan.index("BroadcastHashJoin")]


def test_best_of_askers_and_others(spark):
    rows = [("q", f"o{i}", "x", ["q"], 1.0 - i / 100) for i in range(6)] + [("q", f"p{i}", f"y{i}", None, 0.5 - i / 100) for i in range(6)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, owner string, own_queries array<string>, score double")
    got = {r.doc_id for r in search.cut_to_best(df, 2).select(F.col("doc_id")).collect()}
    assert got == {"o0", "o1", "p0", "p1"}
