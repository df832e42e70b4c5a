"""Embedding whitening from bit-sliced scatter matrices.

Every entry c of a vector becomes the integer x = floor(64 c) + 1000000; the fit list holds each distinct vector of such
integers once.  Entries are shifted by the least of their dimension, and the bits of a dimension are cut into planes:
plane b of dimension i holds bit b of all rows, packed into words.  The product sum of two dimensions is then
``sum over planes a, b of 2^(a+b) * popcount(plane_ia AND plane_jb)``, exact in integers however many rows there are.
Partitions of the fit list give such sums, which are added up in limbs of 40 bits; the scatter is centred as integers
(``n * products - sums * sums``) and only then divided and given to ``eigh``.

``fit`` returns the model (its size grows with the square of the dimensions only, never with rows), ``transform`` the
whitened rows.  Whitening is measured on the fit list itself (``identity_error``).

Nulls: rows whose vector is null or holds null or non-finite entries are dropped, as are empty vectors and those of
another length than the most frequent one (of equally frequent ones the largest).  A null vec_id is kept.  Repeated rows
are all returned; in the fit list they count once.  Entries beyond 2^62 / 64 count as that.  Components whose
eigenvalue can't be told from zero in doubles are left out, so a table with one distinct vector, like an empty one, gives
no rows.  ``deviation`` is null where it does not fit a long.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import record_batch, small_batches
from assayframe.session import Run, cut

COMPONENTS = 16
#: Entries (rows times dimensions) that are sliced at once.
SLICE = 1 << 22
MOST = 1 << 62
_LIMB = 40
_VECTORS = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int64()))])
_LIMITS = pa.schema([("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
_PARTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])
_SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])
_WHITE = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length, none null, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole."""
    small_batches(embeddings.sparkSession)
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding")
            with np.errstate(over="ignore"):
                scaled = np.floor(64 * vectors.flatten().to_numpy(zero_copy_only=False))
            x = np.clip(scaled, -MOST, MOST).astype(np.int64) + 1_000_000
            yield record_batch(_VECTORS, [b.column("vec_id"), pa.ListArray.from_arrays(pa.array(vectors.offsets.to_numpy() - vectors.offsets[0].as_py(), pa.int32()), pa.array(x))])

    return rows.mapInArrow(run, "vec_id long, x array<long>")


def of_usual_length(rows: DataFrame) -> DataFrame:
    usual = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("held")).orderBy(F.desc("held"), F.desc("n")).first()
    return rows.where(F.size("x") == (usual["n"] if usual else 0))


def limits(fit_list: DataFrame) -> tuple[list[int], list[int]]:
    """Least and greatest entry of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield record_batch(_LIMITS, [[low], [high]])

    parts = fit_list.mapInArrow(run, "low array<long>, high array<long>")
    both = parts.select(F.posexplode(F.arrays_zip("low", "high")).alias("i", "x"))
    found = both.groupBy("i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).collect()  # one row a dimension
    found.sort(key=lambda r: r["i"])
    return [r["low"] for r in found], [r["high"] for r in found]


def bit_planes(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """Planes of all dimensions, lower bits first, packed into 64-bit words over the rows."""
    packed = np.zeros((sum(bits), -(-len(shifted) // 64) * 8), np.uint8)
    at = np.concatenate([[0], np.cumsum(bits)])[:-1].astype(np.int64)
    for b in range(max(bits, default=0)):
        dims = [d for d, n in enumerate(bits) if n > b]
        plane = ((shifted[:, dims] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        packed[at[dims] + b, : -(-len(shifted) // 8)] = np.packbits(plane, axis=0).T
    return packed.view(np.uint64)


def plane_products(planes: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(products, sums): exact sums of products of each two dimensions (upper half), and of each dimension, as integers."""
    n = len(bits)
    dim = np.repeat(np.arange(n), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if n else np.empty(0, np.int64)
    kind = np.int64 if 2 * max(bits, default=0) + (64 * planes.shape[1]).bit_length() <= 62 else object
    products, sums = np.zeros((n, n), kind), np.zeros(n, kind)
    for p in range(len(planes)):
        counts = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64).astype(kind)
        sums[dim[p]] += counts[0] << int(bit[p])
        weighted = counts << (bit[p:] + bit[p]).astype(kind)
        weighted[1:][dim[p + 1 :] == dim[p]] *= 2  # planes of one dimension meet twice
        starts = np.flatnonzero(np.diff(dim[p:], prepend=-1))
        products[dim[p], dim[p:][starts]] += np.add.reduceat(weighted, starts)
    return products, sums


def _in_limbs(value: int) -> list[tuple[int, int]]:
    out, limb = [], 0
    while value:
        out.append((limb, value & ((1 << _LIMB) - 1)))
        value, limb = value >> _LIMB, limb + 1
    return out


def scatter(fit_list: DataFrame, low: list[int], high: list[int]) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """Rows of the fit list, and the exact sums and product sums of its entries less ``low``."""
    bits = [(h - a).bit_length() for a, h in zip(low, high, strict=True)]
    rows_at_once = max(64, SLICE // len(low) // 64 * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, totals, n = np.zeros((len(bits), len(bits)), object), np.zeros(len(bits), object), 0

        def add(x: np.ndarray) -> None:
            nonlocal total, totals, n
            shifted = x.view(np.uint64) - np.array(low, np.int64).view(np.uint64)
            products, sums = plane_products(bit_planes(shifted, bits), bits)
            total, totals, n = total + products, totals + sums, n + len(x)

        parts, held = [], 0
        for b in batches:
            if b.num_rows:
                parts.append(_matrix(b.column("x")))
                held += len(parts[-1])
            if held >= rows_at_once:
                add(np.concatenate(parts))
                parts, held = [], 0
        if parts:
            add(np.concatenate(parts))
        out = [(-1, -1, *x) for x in _in_limbs(n)]
        out += [(i, -1, *x) for i in range(len(bits)) for x in _in_limbs(int(totals[i]))]
        out += [(i, j, *x) for i in range(len(bits)) for j in range(i, len(bits)) for x in _in_limbs(int(total[i, j]))]
        if out:
            yield record_batch(_PARTS, zip(*out, strict=True))

    parts = fit_list.mapInArrow(run, "i int, j int, limb int, value long")
    found: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():  # some rows a pair of dimensions
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + (r["value"] << (_LIMB * r["limb"]))
    dims = range(len(bits))
    return found.get((-1, -1), 0), [found.get((i, -1), 0) for i in dims], {(i, j): found.get((i, j), 0) for i in dims for j in dims if i <= j}


@dataclass
class Whitening:
    """What a fit knows: fit rows, least entries, sums over entries less these, components and eigenvalues (falling)."""

    n: int
    low: list[int]
    high: list[int]
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; Python integers where 64 bits would not do."""
        most = self.n * max(max(h - a for a, h in zip(self.low, self.high, strict=True)), 1)
        small = x.view(np.uint64) - np.array(self.low, np.int64).view(np.uint64)
        if most < 1 << 62:
            return self.n * small.astype(np.int64) - np.array(self.sums, np.int64)
        return self.n * small.astype(object) - np.array(self.sums, object)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def covariance(n: int, sums: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Centred as integers, then each entry divided once."""
    out = np.empty((len(sums), len(sums)))
    for (i, j), p in products.items():
        out[i, j] = out[j, i] = (n * p - sums[i] * sums[j]) / (n * n)
    return out


def _measured(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            if b.num_rows:
                w = model.whiten(model.centred(_matrix(b.column("x"))))
                products += w.T @ w
                sums += w.sum(axis=0)
        i, j = np.indices((k, k)).reshape(2, -1)
        yield record_batch(_SUMS, [[*i, *range(k)], [*j, *[-1] * k], [*products.ravel(), *sums]])

    cov, mean = np.zeros((k, k)), np.zeros(k)
    for r in fit_list.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if r["j"] < 0:
            mean[r["i"]] = r["value"] / model.n
        else:
            cov[r["i"], r["j"]] = r["value"] / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Model of a table of distinct vectors ``x``, read several times; None where it has no component."""
    low, high = limits(fit_list)
    if not low:
        return None
    n, sums, products = scatter(fit_list, low, high)
    cov = covariance(n, sums, products)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > 16 * len(low) * np.finfo(float).eps * max(values[-1], 0.0)]
    if not len(order):
        return None
    model = Whitening(n, low, high, sums, vectors[:, order], values[order], float(np.trace(cov)))
    model.identity_error = _measured(fit_list, model)
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of rows (vec_id, x)."""
    span = model.n * max(max(h - a for a, h in zip(model.low, model.high, strict=True)), 1)
    fits = len(model.low) * span * span < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            centred = model.centred(_matrix(b.column("x")))
            squares = (centred if fits else centred.astype(object)) ** 2
            deviation = [d if d < 1 << 63 else None for d in map(int, squares.sum(axis=1))]
            yield record_batch(_WHITE, [b.column("vec_id"), deviation, list(model.whiten(centred))])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """Whitened rows of ``embeddings`` (vec_id, deviation, whitened) and the model fitted on its distinct vectors."""
    tables = Run(embeddings.sparkSession)
    rows = of_usual_length(tables.cut(integers(embeddings)))
    model = fit(tables.cut(rows.select("x").distinct()), components)
    if model is None:
        out = embeddings.sparkSession.createDataFrame([], "vec_id long, deviation long, whitened array<double>")
    else:
        out = cut(transform(rows, model))
    tables.close()
    return out, model
