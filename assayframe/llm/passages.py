"""Removal of repeated passages: every byte of a ``length``-byte string that also starts earlier.

Bucket-pointer refinement without a global sort.  A suffix is named by the bucket
of its first bytes; buckets are refined by the buckets of later offsets:

* The bucket of the ``SEED`` bytes at an offset is their 64-bit hash.  The bucket of any longer
  stretch is made from the buckets at its later offsets (the hash of a window is a
  difference of two running sums), so every refinement reuses the earlier ones.
* Of the offsets in each stretch of ``length`` bytes the one with the smallest seed
  bucket is its anchor; equal stretches have the same anchor.  Only anchors enter
  the first buckets (one offset in about forty), and only buckets with two or more go on.
* An anchor stands for a run of starts.  Its bucket is refined by the bucket of the
  whole text that these starts cover (the context).  All but the first of equal
  contexts are repeats as a whole.  A bucket with a single context is done.
* What is left, the first ones of different contexts in one bucket, is cut into
  parts of ``WIDTH`` starts, which are refined in the same way, and what is left of these into single starts.

"First" is by smaller doc_id, then earlier start.  Counts and firsts are
aggregated before rows meet, so no task gathers a frequent bucket.
Buckets are 64-bit names; contexts and single starts are told apart by their name
together with that of the anchor (128 bits).

Nulls: a null text is an empty one; rows without doc_id are left out.  Rows that repeat a doc_id (with any text) are
told apart by their text; equal rows are one document and get the same result.  Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import in_pieces, raw_texts, record_batch, small_batches, texts
from assayframe.session import Run, cut

LENGTH = 100
SEED = 24
#: Starts in one part of an anchor's run.
WIDTH = 6
_ANCHORS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("seed", pa.int64()), ("name", pa.int64())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        up[k : k + m] = up[:m] * np.uint64(pow(base, k, 1 << 64))
        down[k : k + m] = down[:m] * np.uint64(pow(inverse, k, 1 << 64))
        k += m
    return up, down


class Names:
    """Running sums of a text, from which the bucket of any stretch follows."""

    _bytes = np.random.default_rng(100).integers(0, 1 << 64, 256, dtype=np.uint64)
    _up, _down = _powers(1 << 16)

    def __init__(self, text: bytes):
        n = len(text)
        cls = type(self)
        if n > len(cls._up):
            cls._up, cls._down = _powers(1 << n.bit_length())
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._bytes[np.frombuffer(text, np.uint8)] * self._up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self._down[starts]
        raw ^= raw >> np.uint64(32)
        raw *= _ODD
        return raw ^ (raw >> np.uint64(29))

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        raw = (self.sums[size:] - self.sums[:n]) * self._down[:n]
        raw ^= raw >> np.uint64(32)
        raw *= _ODD
        return raw ^ (raw >> np.uint64(29))


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value in each window of ``width``; of equal ones the leftmost.

    Values are compared by their upper bits; the lower ones give way to the position.
    """
    n = len(values)
    bits = np.uint64(n.bit_length())
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    grid = full.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(right[:m], left[width - 1 : width - 1 + m])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors(text: bytes, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(at, lo, hi, seed name, context name): each anchor with its run of starts lo..hi."""
    none = np.empty(0, np.int64)
    if len(text) < length:
        return none, none, none, none, none
    names = Names(text)
    grams = names.every(seed)
    at = _sliding_argmin(grams, length - seed + 1)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    at = at[lo]
    shape = (at - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)
    context = (names.of(lo, hi + length) ^ shape) * _ODD
    return at, lo, hi, grams[at].view(np.int64), context.view(np.int64)


def _numbered(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, further columns and ``copy``: 0, or a hash of the text where rows share a doc_id."""
    rows = texts(docs) if not columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *columns)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    twice = cut(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("__twice")))
    marked = rows.where(F.col("doc_id").isNotNull()).join(twice, "doc_id", "left")
    return marked.withColumn("copy", F.when(F.col("__twice"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("__twice")


def find_anchors(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple] = []
            held = 0
            for doc_id, copy, text in zip(b.column("doc_id").to_pylist(), b.column("copy").to_pylist(), raw_texts(b), strict=True):
                found = anchors(text, length, seed)
                n = len(found[0])
                if n:
                    parts.append((np.full(n, doc_id), np.full(n, copy), *found))
                    held += n
                if held > 1 << 16:
                    yield from in_pieces([np.concatenate(c) for c in zip(*parts)], _ANCHORS)
                    parts, held = [], 0
            if parts:
                yield from in_pieces([np.concatenate(c) for c in zip(*parts)], _ANCHORS)

    return docs.select("doc_id", "copy", "text").mapInArrow(run, "doc_id long, copy long, at long, lo long, hi long, seed long, name long")


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; touching spans become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    at = np.flatnonzero(new)
    return starts[at], np.concatenate([ends[at[1:] - 1], ends[-1:]])


def _settle(run: Run, rows: DataFrame, bucket: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """Refine buckets by ``name``: spans of all but the first of equal names, and the firsts of buckets with several names."""
    whole_row = F.struct("doc_id", "copy", "at", "lo", "hi", "seed")
    same = run.cut(rows.groupBy(*bucket, "name").agg(F.count(F.lit(1)).alias("n"), F.min(whole_row).alias("first")))
    copies = rows.join(same.where("n > 1").select(*bucket, "name", "first"), [*bucket, "name"])
    copies = copies.where(F.struct("doc_id", "copy", "at") > F.struct("first.doc_id", "first.copy", "first.at"))
    mixed = same.groupBy(*bucket).agg(F.count(F.lit(1)).alias("names")).where("names > 1").select(*bucket)
    spans = copies.select("doc_id", "copy", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    return run.cut(spans), same.join(mixed, bucket).select("first.*")


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, copy, spans): byte spans to remove of each document that has any; they may overlap.

    ``docs`` needs doc_id, copy and text (see ``_numbered``).
    """
    run = Run(docs.sparkSession)
    marks = find_anchors(docs, length, seed)
    often = marks.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    hits = run.cut(marks.join(often, "seed"))
    whole, open_ = _settle(run, hits, ["seed"], length)
    parts = run.cut(_parts(docs, run.cut(open_), length, WIDTH))
    partly, open_ = _settle(run, parts, ["place", "core"], length)
    singles = run.cut(_parts(docs, run.cut(open_), length, 1))
    single, _ = _settle(run, singles, ["place", "core"], length)
    spans = whole.unionByName(partly).unionByName(single)
    found = cut(spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    run.close()
    return found


def _parts(docs: DataFrame, open_: DataFrame, length: int, width: int) -> DataFrame:
    """Runs of starts cut at shifts (from the anchor) divisible by ``width``.

    ``place`` names anchor bucket and shift, ``core`` the text that all strings of a
    full part have in common, so different cores share no string; ``name`` the text of the part.
    """
    lists = open_.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("at", "lo", "hi", "seed")).alias("runs"))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "copy", "at", "lo", "hi", "seed", "place", "core", "name")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies, found = b.column("doc_id").to_pylist(), b.column("copy").to_pylist(), b.column("runs")
            ends = found.offsets.to_numpy() - found.offsets[0].as_py()
            all_runs = [found.flatten().field(c).to_numpy() for c in ("at", "lo", "hi", "seed")]
            held, out = 0, []
            for k, text in enumerate(raw_texts(b)):
                at, lo, hi, seed = (c[ends[k] : ends[k + 1]] for c in all_runs)
                first, last = (lo - at) // width, (hi - at) // width
                many = last - first + 1
                owner = np.repeat(np.arange(len(at)), many)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
                at, seed = at[owner], seed[owner]
                lo, hi = np.maximum(lo[owner], at + step * width), np.minimum(hi[owner], at + step * width + width - 1)
                names = Names(text)
                shape = (lo - at - step * width).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)
                name = (names.of(lo, hi + length) ^ shape) * _ODD
                core = names.of(at + step * width + width - 1, at + step * width + length)
                place = seed.view(np.uint64) * _ODD + step.astype(np.uint64)
                out.append((np.full(len(at), ids[k]), np.full(len(at), copies[k]), at, lo, hi, seed, place.view(np.int64), core.view(np.int64), name.view(np.int64)))
                held += len(at)
                if held > 1 << 16:
                    yield from in_pieces([np.concatenate(c) for c in zip(*out)], schema)
                    held, out = 0, []
            if held:
                yield from in_pieces([np.concatenate(c) for c in zip(*out)], schema)

    ddl = ", ".join(f"{f.name} long" for f in schema)
    return docs.select("doc_id", "copy", "text").join(lists, ["doc_id", "copy"]).mapInArrow(run, ddl)


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, ``columns`` and ``spans`` (byte spans to remove, null: none) of each row of ``docs``."""
    rows = _numbered(docs, columns)
    spans = repeated_spans(rows.select("doc_id", "copy", "text"), length, seed)
    return rows.join(spans, ["doc_id", "copy"], "left").drop("copy")


def digest(removed: DataFrame) -> DataFrame:
    """Counts and SHA-256 of what is left of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, spans in zip(b.column("doc_id").to_pylist(), raw_texts(b), b.column("spans"), strict=True):
                a, z = kept_spans(spans)
                left = text if not len(a) else drop_spans(text, a, z)
                out.append((doc_id, len(text), len(text) - len(left), len(a), hashlib.sha256(left).hexdigest()))
            yield record_batch(schema, list(zip(*out)) if out else [[]] * 5)

    return removed.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_spans(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of a row's span list."""
    items = spans.values
    if items is None or not len(items):
        none = np.empty(0, np.int64)
        return none, none
    return _merge(items.field("a").to_numpy(zero_copy_only=False), items.field("b").to_numpy(zero_copy_only=False))


def drop_spans(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` and ``n_chars`` counted anew.

    A character is cut only if all its bytes are.  All rows stay, also those whose text becomes empty.
    """
    named = {c: f"__{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # their names may be ours
    removed = remove_repeats(docs.withColumnsRenamed(named), length, seed, tuple(named.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for text, spans in zip(raw_texts(b), b.column("spans"), strict=True):
                a, z = kept_spans(spans)
                if len(a):
                    inner = (np.frombuffer(text + b"a", np.uint8) & 0xC0) == 0x80  # bytes within a character
                    while len(bad := np.flatnonzero(inner[a])):
                        a[bad] += 1
                    while len(bad := np.flatnonzero(inner[z])):
                        z[bad] -= 1
                    text = drop_spans(text, a, z)
                left.append(text.decode("utf-8"))
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pa.array(left, pa.string())).drop_columns(["spans"])

    shape = removed.drop("spans")
    out = removed.mapInArrow(run, shape.schema)
    out = out.withColumnsRenamed({v: c for c, v in named.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
