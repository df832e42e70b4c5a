"""Quality posteriors, mixing rates and the pipeline on small tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayframe.llm.mixing import TARGETS, copies, mixing_rates
from assayframe.llm.near_copies import near_copies
from assayframe.llm.q_corpus import site
from assayframe.llm.quality import quality_posteriors

from .data import documents, prose, texts, words

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows_are_judged(spark):
    docs = documents(spark)
    for rows in ([], [(0, None, None), (6, 1, 0), (7, 0, 0), (11, 0, 1)]):
        out = quality_posteriors(docs, _labels(spark, rows), *site(docs)).collect()
        assert len(out) == docs.count() and all(0 <= r.posterior <= 1 for r in out)
        assert mixing_rates(docs, _labels(spark, rows)).where("rate >= 0").count() == docs.count()
    empty = documents(spark, [])
    assert quality_posteriors(empty, _labels(spark, []), *site(empty)).count() == 0
    assert mixing_rates(empty, _labels(spark, [])).count() == 0


@needs_tables
def test_held_out_accuracy_and_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("doc_id % 2 = 0")
    judged = quality_posteriors(docs, learn, *site(docs)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right >= 0.95
    rates = mixing_rates(docs, labels)
    weight = F.sum(F.col("rate") * F.col("n_tokens"))
    got = rates.agg(*((F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{k}")) / weight).alias(k) for k in TARGETS)).first()
    assert all(abs(got[k] - w) < 0.01 for k, w in TARGETS.items())
    assert rates.withColumn("c", copies(F.col("rate"), F.col("doc_id"))).where("abs(c - rate) >= 1").count() == 0


@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= left
        left = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == left


def _copies(rows):
    """Groups by all pairs: equal ids, or five-word shingles with a Jaccard similarity of at least 0.8."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * min(len(sets[a]), len(sets[b])) < 4 * max(len(sets[a]), len(sets[b])) and rows[a][0] != rows[b][0]:
                continue  # sizes alone rule it out
            both = len(sets[a] & sets[b])
            near = sets[a] == sets[b] or both and 5 * both >= 4 * len(sets[a] | sets[b])
            if (near or rows[a][0] == rows[b][0]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    return {i: min(j for (j, _), h in zip(rows, group) if h == g) for (i, _), g in zip(rows, group)}


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(11)
    passage = prose(rng, 40)
    rows = list(enumerate(texts()))
    for size in (30, 90, 400):  # copies around the threshold
        text = prose(rng, size).split()
        for changes in range(12):
            near = list(text)
            for _ in range(changes * size // 90):
                near[rng.randrange(size)] = f"w{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(near)))
    crowd = prose(rng, 120).split()
    for k in range(90):  # crowds: near copies, texts that share most of a passage, and chains
        near = list(crowd)
        near[rng.randrange(120)] = f"c{k}"
        near[rng.randrange(120)] = f"d{k % 7}"
        rows.append((len(rows), " ".join(near)))
        rows.append((len(rows), passage + " " + " ".join(f"x{rng.randrange(3)}" for _ in range(rng.randrange(4, 14)))))
    rows += [(3, rows[40][1]), (7, "other words of the same id")]
    got = {r.doc_id: r.component_id for r in near_copies(documents(spark, rows)).collect()}
    assert got == _copies(rows)
    assert near_copies(documents(spark, [])).count() == 0


@needs_tables
def test_no_near_copies_stay(spark):
    """Planted near copies leave the pipeline's second stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect())
    assert kept == sorted({c for c in _copies(rows).values()})


def test_simhash_groups_leave_with_near_copies(spark, monkeypatch):
    """The pipeline's second stage takes the groups of SimHash, joined by near copies of any member."""
    rng = random.Random(3)
    a, b, c = (prose(rng, 60) for _ in range(3))
    docs = documents(spark, [(1, a), (2, b), (3, b + " end"), (4, c), (None, a)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2, 4]
    groups = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 3), (4, 0, 4)], "doc_id long, fp long, component_id long")
    monkeypatch.setattr(corpus_pipeline, "simhash_components", lambda d: groups)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 4]
