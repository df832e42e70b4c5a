"""SimHash groups, repeated passages and near-duplicate vectors against brute force."""

import hashlib
import random

import numpy as np
import xxhash

from assayframe.llm.components import components
from assayframe.llm.lattice import lattice_links
from assayframe.llm.passages import digest, remove_repeats, without_repeats
from assayframe.llm.simhash import fingerprint, fingerprint_links, simhash_components

from .data import documents, raw, texts, words


def _fingerprint(t):
    w = words(t)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups(spark):
    rows = list(enumerate(texts()))
    fps = {i: _fingerprint(t) for i, t in rows}
    assert all(fingerprint(raw(t)) == fps[i] for i, t in rows)
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    got = {r.doc_id: r.component_id for r in simhash_components(documents(spark)).collect()}
    assert got == _groups(fps, linked)


def test_links_of_a_crowded_table_entry(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    fps = sorted({base ^ sum(1 << rng.randrange(20) for _ in range(rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(200)})
    reps = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, rep long")
    got = {r.id: r.component for r in components(fingerprint_links(reps)).collect()}
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = _groups(range(len(fps)), linked)
    assert all(got.get(i, i) == want[i] for i in want)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(5, 5), (None, 3)], "a long, b long")
    assert {r.component for r in components(links).collect()} == {0}


def _without(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        t = raw(t)
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(t[p : p + length])
        left = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out


def test_repeated_passages(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: tuple(r)[1:] for r in digest(remove_repeats(documents(spark))).collect()}
    assert got == _without(rows)


def test_passages_of_repeated_ids_and_columns(spark):
    rows = [(1, "x" * 250), (1, "x" * 250), (2, "é" * 200), (3, "a" + "é" * 200), (None, "q" * 300)]
    docs = documents(spark, rows)
    out = without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert [g[0] for g in got] == [1, 1, 2, 3]
    assert got[0] == got[1] and len(got[0][1]) < 250
    assert digest(remove_repeats(documents(spark, []).where("false"))).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    near = base[rng.integers(0, 40, 200)] + 0.04 * rng.standard_normal((200, 16))
    crowd = base[0] + 0.02 * rng.standard_normal((700, 16))
    x = np.concatenate([base, near, crowd, base[:5]])
    label = rng.integers(0, 3, len(x))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x.astype(np.float32), label))]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None], 1), (5003, [float("nan")] * 16, 1), (5004, base[0].tolist(), None), (5005, [], 1), (None, [1.0], 1)]
    got = {r.vec_id: r for r in lattice_links(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows) + len(odd)
    v = x.astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= links[i].sum() for i in range(len(x)))
    assert found >= 0.9 * links.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(5000, 5006))


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((1500, 64))
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9805 * a + np.sqrt(1 - 0.9805**2) * o
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, b]))]
    out = lattice_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert out.where("n_links > 0").count() >= 0.9 * 3000


def test_columns_named_like_the_operators_own(spark):
    docs = documents(spark)
    clash = docs.selectExpr("*", "1 as copy", "'x' as spans", "2 as n2", "3 as __twice", "'k' as `key`")
    want = {(r.doc_id, r.text) for r in without_repeats(docs).collect()}
    got = without_repeats(clash)
    assert got.columns == clash.columns and {(r.doc_id, r.text) for r in got.collect()} == want
    assert without_repeats(clash).where("copy = 1 and spans = 'x' and `key` = 'k'").count() == docs.count()


def test_lattice_row_without_id_takes_no_links(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [1.0, 2.0], None)]
    found = lattice_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found} == {(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (3, 0, 3, True)}
