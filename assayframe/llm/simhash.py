"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to many reference
fingerprints (pivots).  A distance to a pivot moves by at most the distance of
two fingerprints, so linked fingerprints (at most ``MAX_BITS`` bits apart) differ
by at most ``MAX_BITS`` in every coordinate.  The pivots are a base and, for each
of 32 segments of two bits, the base with that segment turned over: from two
coordinates follows the distance within a segment, and over disjoint segments
these differences add up to at most ``MAX_BITS``.  The segments form five groups,
so in at least three groups all coordinates agree: each choice of three groups is
one table, keyed by the coordinates, and only fingerprints that agree in a table
are compared.  Pairs whose largest coordinate difference (over the base, the
segments and 16 free pivots) is over ``MAX_BITS`` are discarded, survivors are
verified on the bits.  Fingerprints in a table entry of more than ``ENTRY``
members are not compared in pairs: they are hung on all fingerprints one bit away
from them, and two are at most two bits apart just when they share one; that is
exact and linear.

Nulls: a null text is an empty one; rows without doc_id are left out.  Texts
without words have fingerprint zero and link like any other.  Rows that repeat a
doc_id keep one row each and share its smallest id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import raw_texts, record_batch, small_batches, texts
from assayframe.llm.components import components
from assayframe.session import cut

MAX_BITS = 2
SHINGLE = 3
GROUPS = 5
ENTRY = 64
_HASHES = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_TABLES = pa.schema([("fp", pa.int64()), ("rep", pa.int64()), ("coords", pa.list_(pa.int8())), ("keys", pa.list_(pa.int64()))])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 (seed 42) bits of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends)])
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    n = len(hashes)
    over = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        over += np.unpackbits(hashes[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits in a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record_batch(_HASHES, [b.column("doc_id"), [_signed(fingerprint(t, shingle)) for t in raw_texts(b)]])

    return texts(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, fp long")


def _pivots() -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Base with its 32 turned segments, the segments of each group, and 16 free pivots."""
    rng = np.random.default_rng(64)
    base, *free = rng.integers(0, 1 << 64, 17, dtype=np.uint64)
    turned = [base ^ np.uint64(3 << (2 * s)) for s in range(32)]
    return np.array([base, *turned], np.uint64), [list(range(g, 32, GROUPS)) for g in range(GROUPS)], np.array(free, np.uint64)


def pivot_table(reps: DataFrame) -> DataFrame:
    """(fp, rep, coords, keys): distances to all pivots, and one key for each table."""
    pivots, groups, free = _pivots()
    tables = [sorted(s for g in c for s in groups[g]) for c in combinations(range(GROUPS), GROUPS - MAX_BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            near = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int64)
            part = (near[:, :1] - near[:, 1:] + 2) // 2  # distance to the base within each segment: 0, 1 or 2
            far = np.bitwise_count(fp[:, None] ^ free[None, :]).astype(np.int64)
            coords = np.concatenate([near[:, :1], part, far], axis=1).astype(np.int8)
            keys = np.stack([(part[:, t] * 3 ** np.arange(len(t))).sum(axis=1) * len(tables) + k for k, t in enumerate(tables)], axis=1)
            yield record_batch(_TABLES, [b.column("fp"), b.column("rep"), list(coords), list(keys)])

    return reps.mapInArrow(run, "fp long, rep long, coords array<tinyint>, keys array<long>")


def fingerprint_links(reps: DataFrame) -> DataFrame:
    """Links (a, b) between ``rep`` ids that join all fingerprints at most ``MAX_BITS`` bits apart."""
    keyed = cut(pivot_table(reps)).select("fp", "rep", "coords", F.explode("keys").alias("key"))
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = keyed.join(sizes.where(F.col("n") <= ENTRY).select("key"), "key")
    a, b = few.alias("a"), few.select(*(F.col(c).alias(f"{c}2") for c in few.columns)).alias("b")
    apart = F.zip_with("coords", "coords2", lambda x, y: F.abs(x - y))
    pairs = (
        a.join(b, (F.col("key") == F.col("key2")) & (F.col("fp") < F.col("fp2")))
        .where(F.array_max(apart) <= MAX_BITS)
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS)
        .select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    )
    many = keyed.join(sizes.where(F.col("n") > ENTRY).select("key"), "key", "left_semi").select("fp", "rep").distinct()
    turned = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))
    near = many.select("rep", F.explode(turned).alias("near"))
    hub = near.groupBy("near").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a < top")
    hung = near.join(hub.select("near", "a"), "near").where("a < rep").select("a", F.col("rep").alias("b"))
    return pairs.unionByName(hung).distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    marked = cut(fingerprints(docs, shingle))
    reps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(fingerprint_links(reps).unionByName(_same_id(marked, reps)))
    least = reps.join(found, reps.rep == found.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(least, "fp").select("doc_id", "fp", "component_id")


def _same_id(marked: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id with another text are one node."""
    twice = marked.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    return twice.join(marked, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
