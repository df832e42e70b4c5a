"""A small text classifier: shares of characters and words, and a lexicon learnt from labels.

Fitted by logistic regression on at most ``SAMPLE`` labelled documents (those with the smallest
hash of doc_id); applied to whole texts of all documents.  Without labelled documents all
classes are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import in_pieces, raw_texts, small_batches, texts
from assayframe.session import cut

SAMPLE = 6000
LEXICON = 100
LEXICON_DOCS = 8
LEXICON_SHARE = 0.6
STEPS = 400
_SYMBOLS = b"#*$%&|<>!.,"


@dataclass
class Model:
    lexicons: list[list[str]]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # (features + 1, classes)
    shares: np.ndarray  # of the classes among the sample


def _kinds() -> np.ndarray:
    """Class of each byte: symbols one by one, then letters, capitals, digits, spaces, other, non-ASCII."""
    kind = np.full(256, len(_SYMBOLS) + 4)
    kind[128:] = len(_SYMBOLS) + 5
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\n\x0b\f\r")):
        kind[list(chars)] = len(_SYMBOLS) + k
    for k, c in enumerate(_SYMBOLS):
        kind[c] = k
    return kind


KINDS = _kinds()
N_KINDS = len(_SYMBOLS) + 6


def features(b: pa.RecordBatch, lexicons: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features (rows, features) and word counts of a batch's texts."""
    raw = raw_texts(b)
    by_byte = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in raw]).reshape(len(raw), 256)
    chars = np.stack([by_byte[:, KINDS == k].sum(axis=1) for k in range(N_KINDS)], axis=1)
    size = np.maximum(chars.sum(axis=1), 1)
    words = pc.ascii_split_whitespace(pc.ascii_lower(b.column("text")))
    coded = words.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(raw)), words.value_lengths().to_numpy())
    real = pc.binary_length(coded.dictionary).to_numpy() > 0 if len(coded.dictionary) else np.empty(0, bool)
    n = np.bincount(owner, real[which], len(raw)).astype(np.int64) if len(which) else np.zeros(len(raw), np.int64)
    distinct = np.bincount(np.unique(owner * (len(real) + 1) + which) // (len(real) + 1), minlength=len(raw)) if len(which) else n
    lines = [t.split(b"\n") for t in raw]
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    columns = [chars / size[:, None], np.log1p(n)[:, None], (size / np.maximum(n, 1))[:, None], (distinct / np.maximum(n, 1))[:, None], repeated[:, None]]
    for lexicon in lexicons:
        inside = pc.is_in(coded.dictionary, pa.array(lexicon, pa.string())).to_numpy(zero_copy_only=False) if len(real) else real
        hits = np.bincount(owner, inside[which], len(raw)) if len(which) else np.zeros(len(raw))
        columns += [np.minimum(hits, 3)[:, None], (hits / np.maximum(n, 1))[:, None]]
    return np.concatenate(columns, axis=1), n


def _lexicons(sample: DataFrame, classes: int) -> list[list[str]]:
    """Words that stand mostly in documents of one class, at most ``LEXICON`` for each class but the first."""
    schema = pa.schema([("y", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(y, w) for y, t in zip(b.column("y").to_pylist(), raw_texts(b)) for w in sorted(set(t.lower().decode("utf-8").split()))]
            if found:
                yield from in_pieces(list(map(list, zip(*found))), schema)

    seen = sample.mapInArrow(run, "y long, word string").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("y") == k).alias(f"n{k}") for k in range(classes)))
    out = []
    for k in range(1, classes):
        marked = seen.where((F.col(f"n{k}") >= LEXICON_DOCS) & (F.col(f"n{k}") >= LEXICON_SHARE * F.col("n")))
        out.append(sorted(r["word"] for r in marked.orderBy(F.desc(f"n{k}"), "word").limit(LEXICON).collect()))
    return out


def fit(docs: DataFrame, labels: DataFrame, classes: int) -> Model:
    """``labels`` has doc_id and y (0 .. classes - 1); null labels are left out."""
    small_batches(docs.sparkSession)
    chosen = labels.where("y is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("long").alias("y"))
    chosen = chosen.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = chosen.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = cut(texts(docs).join(F.broadcast(chosen), "doc_id").limit(SAMPLE))  # SAMPLE rows at most
    lexicons = _lexicons(sample, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = features(b, lexicons)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = sorted((r["y"], r["x"]) for r in sample.mapInArrow(run, "y long, x array<double>").collect())
    width = N_KINDS + 4 + 2 * len(lexicons)
    x = np.array([r[1] for r in rows]).reshape(len(rows), width)
    y = np.array([r[0] for r in rows], int)
    shares = (np.bincount(y, minlength=classes) + 1) / (len(y) + classes)
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    z = np.concatenate([np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))], axis=1)
    weights, speed = np.zeros((width + 1, classes)), 0.0
    goal = np.eye(classes)[y]
    for _ in range(STEPS if len(x) else 0):
        slope = z.T @ (_softmax(z @ weights) - goal) / len(x) + 1e-4 * weights
        speed = 0.9 * speed - 0.1 * slope
        weights = weights + speed
    return Model(lexicons, mean, spread, weights, shares)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, n_words and ``p`` (probability of each class) of each row; needs doc_id, text and ``keep``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = features(b, model.lexicons)
            z = np.concatenate([np.clip((x - model.mean) / model.spread, -8, 8), np.ones((len(x), 1))], axis=1)
            p = pa.array(list(_softmax(z @ model.weights)), pa.list_(pa.float64()))
            yield b.drop_columns(["text"]).append_column("n_words", pa.array(n, pa.int64())).append_column("p", p)

    shape = rows.drop("text").withColumn("n_words", F.lit(0).cast("long")).withColumn("p", F.array().cast("array<double>")).schema
    return rows.mapInArrow(run, shape)
