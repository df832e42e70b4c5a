"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assayframe.llm import best_positions as bp
from assayframe.llm.best_positions import ImpactLists, search, term_counts

from .data import documents, prose, texts


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _expected(docs, items, k=20):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n, total = len(counts), sum(x for *_, x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, length in counts:
            m = 100 - 25 + (25 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in _terms(text) if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def _items(spark, rows):
    return spark.createDataFrame([(i, t, -1, "clash") for i, t in rows], "item_id long, text string, rank int, term string")


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    return [(1, prose(rng, 12)), (2, "stone"), (2, "River river RIVER"), (3, None), (4, ""), (5, "nowhere"), (6, "ünïcode É — text"), (7, "a b c x y z 12,345.67"), (8, prose(rng, 40)), (9, "the of and")]


@pytest.mark.parametrize(("block", "step"), [(1 << 22, 32), (50, 1)])
def test_search(spark, items, block, step, monkeypatch):
    monkeypatch.setattr(bp, "BLOCK", block)
    monkeypatch.setattr(bp, "STEP", step)
    rows = [*enumerate(texts()), (None, "stone river"), (3, "repeated id river"), *((100 + k, "copy of a stone market letter") for k in range(60))]
    got = search(documents(spark, rows), _items(spark, items))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == _expected(rows, items)


def test_items_in_groups(spark, items, monkeypatch):
    monkeypatch.setattr(bp, "GROUP_BYTES", 100)
    rows = list(enumerate(texts()))
    assert Counter(map(tuple, search(documents(spark, rows), _items(spark, items)).collect())) == _expected(rows, items)


def test_empty_tables(spark, items):
    assert search(documents(spark, []), _items(spark, items)).collect() == []
    assert search(documents(spark), _items(spark, [])).collect() == []
    assert search(documents(spark, [(1, None), (2, "  ")]), _items(spark, items)).collect() == []


def test_terms(monkeypatch):
    monkeypatch.setattr(bp, "PIECE", 50)
    for t in texts():
        assert term_counts((t or "").encode()) == Counter(x.encode() for x in _terms(t))


def test_stops_before_the_end_and_not_on_a_tie():
    n = 20_000
    rng = np.random.default_rng(1)
    tfs = np.stack([rng.integers(1, 50, n), rng.integers(1, 50, n)], axis=1).ravel()
    lists = ImpactLists(np.full(n, 100), np.full(n, 2), np.tile([0, 1], n), tfs, np.array([5000, 3000]))
    touched = []
    place = lists.place
    lists.place = type("P", (), {"__getitem__": lambda _, s: touched.append(1) or place[s]})()
    rows, scores = lists.search([(0, 1), (1, 2)], 20, 0)
    impact = np.array([5000, 6000]) * ((1_000_000_000 * tfs.reshape(-1, 2)) // (1000 * tfs.reshape(-1, 2) + 1200))
    whole = impact.sum(axis=1)
    least = np.sort(whole)[-20]
    assert set(rows.tolist()) == set(np.flatnonzero(whole >= least).tolist())
    assert (whole[rows] == scores).all() and len(touched) < 2 * 10  # far fewer steps than reading all
