"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table gives each document a posterior over the domains.  Rates
r >= 0 of the documents minimise

    sum over domains k of ((expected tokens of k - target of k) / total)**2 / share of k
    + RIDGE * sum over documents of (tokens / total) * (rate - 1)**2

with expected tokens of k = sum of rate * tokens * posterior of k, by projected gradient.  A step needs
only the few domain sums of the current rates: each pass over the narrow table replays
the steps so far for every document and returns these sums, so no rates travel and none are
stored between passes.  The last pass writes the rates.

Nulls: a null text is an empty one (no tokens, rate 1 or what its posterior gives); a null doc_id is kept.
Repeated rows get rates each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.classifier import fit, predict
from assayframe.session import cut

#: Domains of the labelled table and their target weights.
TARGETS = {"clean": 0.90, "low": 0.04, "toxic": 0.06}
RIDGE = 1e-4
MOST_STEPS = 60
CLOSE = 1e-4


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and y: 0 clean, 1 low quality, 2 toxic."""
    y = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select("doc_id", y.alias("y"))


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given steps, each a gradient over the domains."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - (p @ g + RIDGE * (r - 1)) / (1 + RIDGE))
    return r


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("p").flatten().to_numpy().reshape(b.num_rows, k)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens (words), posteriors ``p``, rate and ``top_rate`` (that of a document surely of the first domain)."""
    names = list(targets)
    k = len(names)
    model = fit(docs, domain_labels(labels), k)
    known = cut(predict(docs, model))
    wanted = np.array([targets[n] for n in names]) / sum(targets.values())

    def sums(steps: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k)
            for b in batches:
                p = _matrix(b, k)
                out += (p * (_rates(p, steps) * b.column("n_words").to_numpy())[:, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(out)], names=["k", "s"])

        found = known.select("n_words", "p").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()  # one row for each domain
        out = np.zeros(k)
        for r in found:
            out[r["k"]] = r["s"]
        return out

    now = sums([])
    total, share = max(now.sum(), 1.0), np.maximum(now / max(now.sum(), 1.0), 1e-6)
    steps: list[np.ndarray] = []
    while len(steps) < MOST_STEPS and np.abs(now / total - wanted).max() > CLOSE and now.sum() > 0:
        steps.append((now / total - wanted) / share)
        now = sums(steps)
    top = float(_rates(np.eye(k)[:1], steps)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("rate", pa.array(_rates(_matrix(b, k), steps)))

    shape = known.withColumn("rate", F.lit(0.0)).schema
    posteriors = [F.get("p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(names)]
    return known.mapInArrow(run, shape).select("doc_id", F.col("n_words").alias("n_tokens"), *posteriors, "rate", F.lit(top).alias("top_rate"))


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies of a document: the rate rounded up or down by a hash of its id, right on average."""
    part = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("long")
