"""Whitening against plain integer and numpy work."""

import math
import random

import numpy as np
import pytest

from assayframe.llm import whitening as w
from assayframe.llm.q_whitening import op12_bit_sliced_whitening
from assayframe.llm.whitening import bit_planes, plane_products, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def _table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, i and i % 3, "clash", -1) for i, v in vectors], schema)


def _expected(vectors, length):
    """By brute force: (n, deviation by row, covariance), in Python integers and fractions."""
    rows = {}
    for k, (i, v) in enumerate(vectors):
        if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v):
            rows[k] = (i, tuple(math.floor(64 * c) + 1000000 for c in v))
    fit = sorted({x for _, x in rows.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = [(i, x, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in rows.values()]
    cov = np.array([[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit) / n**3 for b in range(length)] for a in range(length)])
    return n, dev, cov, np.array(sums, float) / n


def _vectors(rng, count, dims, spread=1.0):
    out = [(k, [float(np.float32(rng.gauss(0, spread) + (0.5 * j))) for j in range(dims)]) for k in range(count)]
    out += [(1000 + k, list(out[3][1])) for k in range(30)]  # a frequent vector
    out += [(None, list(out[4][1])), (None, [0.25] * dims), (7, [1.0] * dims), (7, [1.0] * dims)]
    out += [(2000, None), (2001, [float("nan")] * dims), (2002, [None] + [1.0] * (dims - 1)), (2003, [float("-inf")] + [0.0] * (dims - 1)), (2004, []), (2005, [1.0])]
    return out


@pytest.mark.parametrize(("dims", "slice_"), [(5, 1 << 22), (20, 64 * 20)])
def test_whitening(spark, tmp_path, dims, slice_, monkeypatch):
    monkeypatch.setattr(w, "SLICE", slice_)
    vectors = _vectors(random.Random(4), 200, dims)
    _table(spark, vectors).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_bit_sliced_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    n, dev, cov, mean = _expected(vectors, dims)
    values, base = np.linalg.eigh(cov)
    values, base = values[::-1], base[:, ::-1]
    k = min(16, dims)
    assert len(got) == k * len(dev) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for i, _, d in dev)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    want = {c: sorted(((np.array(x) - mean) @ base[:, c - 1] / math.sqrt(values[c - 1])).item() for _, x, _ in dev) for c in range(1, k + 1)}
    for c in range(1, k + 1):
        mine = sorted(r.whitened for r in got if r.component == c)
        assert np.allclose(mine, want[c], atol=1e-6) or np.allclose(mine, sorted(-v for v in want[c]), atol=1e-6)
        assert all(abs(r.explained / (values[c - 1] / cov.trace()) - 1) < 1e-9 for r in got if r.component == c)


def test_plane_products_are_exact():
    rng = np.random.default_rng(3)
    for bits in ([1, 3, 0, 7], [40, 2], [62, 63, 5]):
        x = np.stack([rng.integers(0, (1 << b) - 1, 300, dtype=np.uint64, endpoint=True) if b else np.zeros(300, np.uint64) for b in bits], axis=1)
        products, sums = plane_products(bit_planes(x, bits), bits)
        whole = [[int(v) for v in row] for row in x]
        assert [int(s) for s in sums] == [sum(c) for c in zip(*whole)]
        for i in range(len(bits)):
            for j in range(i, len(bits)):
                assert int(products[i, j]) == sum(r[i] * r[j] for r in whole)


def test_no_components(spark):
    for vectors in ([], [(1, None)], [(1, [0.5, 0.25])], [(k, [0.5, 0.25]) for k in range(9)]):
        rows, model = whiten(_table(spark, vectors))
        assert rows.collect() == [] and model is None


def test_rank_below_the_dimensions(spark):
    rows, model = whiten(_table(spark, [(k, [float(k), 2.0 * k, 1.0]) for k in range(50)]))
    assert len(model.values) == 1 and abs(model.values[0] / model.trace - 1) < 1e-12 and rows.count() == 50


def test_very_large_entries(spark):
    vectors = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1e16]), (4, [2.0, 3.0])]
    rows, model = whiten(_table(spark, vectors, SCHEMA.replace("array<float>", "array<double>")))
    assert model.n == 4 and {r.deviation for r in rows.collect()} == {None} and model.identity_error < 1e-4
