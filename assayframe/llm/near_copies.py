"""Near copies: all pairs of texts whose five-word shingles have a Jaccard similarity of at least 0.8.

The bits of a SimHash cannot find these pairs (copies at 0.8 are up to 14 and more of 64 bits apart, and no table of
exact agreement serves such a distance), so candidates come from an exact prefix filter.  The shingles of every text
are put in one global order, frequent ones last; two sets of similarity 0.8 share at least one of the first
``n - ceil(0.8 n) + 1`` of each.  The order rests on rough counts, which may be wrong without harm to the result.
Pairs that share too few of these first shingles to reach 0.8 any more are discarded, and all others are verified on
the whole sets (of 64-bit hashes).

The texts that share a first shingle are not compared in pairs: in each round every shingle has some centres, all its
texts of other components are compared with these, and the links found are contracted.  A shingle is done when its texts
lie in one component, a centre when it has been compared; a shingle has four times as many centres in each next round, so
unlike texts are all compared after few rounds, while a group of copies, of any size, is done after the first.  Pairs never
compared lie in one component already, so components are exact.

Nulls: a null text is an empty one; rows without doc_id are left out.  Texts without words are copies of each other.
Rows that repeat a doc_id belong together.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import raw_texts, record_batch, small_batches, texts
from assayframe.llm.components import components
from assayframe.session import Run, cut

SHINGLE = 5
BUCKETS = 1 << 21
_COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
_MARKS = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])
_SETS = pa.schema([("sid", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes (XXH64, seed 42) of the distinct shingles; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        return np.frombuffer(digest(joined, 42), ">u8").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - SHINGLE + 1].tolist()
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def _name(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63)


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(BUCKETS - 1)).astype(np.int64)


def common_buckets(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of shingles that stand out in some part of the table, and their counts there; at most ``BUCKETS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        for b in batches:
            for t in raw_texts(b):
                counts[np.unique(_buckets(shingle_set(t)))] += 1
        mean = counts.sum(dtype=np.int64) / BUCKETS
        out = np.flatnonzero(counts > mean + 6 * mean**0.5 + 4)
        for k in range(0, len(out), 65536):
            yield record_batch(_COUNTS, [out[k : k + 65536], counts[out[k : k + 65536]].astype(np.int64)])

    found = docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: r["bucket"])
    return np.array([r["bucket"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, n, keys): name and size of the set of shingles, and its first shingles in the global order."""
    often, counts = common_buckets(docs)

    def first(s: np.ndarray) -> np.ndarray:
        weight = np.zeros(len(s), np.int64)
        if len(often):
            b = _buckets(s)
            at = np.minimum(np.searchsorted(often, b), len(often) - 1)
            weight = np.where(often[at] == b, counts[at], 0)
        return s[np.lexsort((s, weight))[: len(s) - -(-4 * len(s) // 5) + 1]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in raw_texts(b)]
            yield record_batch(_MARKS, [b.column("doc_id"), [_name(s) for s in sets], [len(s) for s in sets], [first(s) for s in sets]])

    return docs.mapInArrow(run, "doc_id long, sid long, n int, keys array<long>")


def _sizes_fit() -> Column:
    return (5 * F.col("n") >= 4 * F.col("n2")) & (5 * F.col("n2") >= 4 * F.col("n"))


def _fit_to_link(left: DataFrame) -> DataFrame:
    """Rows (key, sid, n, c) that may still find a partner, with ``m``: how many first shingles the set has in ``left``.

    Its other first shingles are held by its own component only, or by texts that it has been compared with.  Two sets
    share at most the lesser ``m`` and what stands behind the first shingles of the larger set (see ``_can_reach``), so
    sets of about one size need a larger ``m`` than a set and its part.  A row stays if by size and ``m`` some text of
    its shingle may go with it, looked up by bands of size that hold all fitting sizes.
    """
    held = left.groupBy("sid").agg(F.count(F.lit(1)).alias("m"))
    rows = left.join(held, "sid").withColumn("band", F.floor(F.log(1.26, "n")))
    bands = rows.groupBy("key", "band").agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.max("m").alias("most"))
    near = rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(bands, ["key", "band"])
    shared, larger = 90 * F.least("m", "most"), F.least(F.col("greatest").cast("long"), F.floor(5 * F.col("n") / 4))
    with_less = (F.col("least") <= F.col("n")) & (shared + 32 * F.col("n") >= 40 * F.col("least"))
    with_more = (larger >= F.col("n")) & (shared + 32 * larger >= 40 * F.col("n"))
    return near.where(with_less | with_more).groupBy("key", "sid").agg(*(F.first(c).alias(c) for c in ("n", "c", "m")))


def _can_reach(firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough of their first shingles to have a similarity of 0.8.

    Shingles that both hold are among the first of both, or behind the first of the one whose first ones end earlier.
    """
    one, two = (firsts.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"k{c}")) for c in "ab")
    both = pairs.join(two, "b").join(one, "a")
    behind = F.greatest(*(F.ceil(4 * F.col(c) / 5) - 1 for c in ("na", "nb")))
    return both.where(9 * (F.size(F.array_intersect("ka", "kb")) + behind) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, tables: Run) -> DataFrame:
    """Pairs (a, b) of set names whose sets have a similarity of 0.8 or more; ``pairs`` is a written table."""
    ids = tables.cut(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
    wanted = docs.join(tables.cut(names.join(ids, "sid").select("doc_id").distinct()), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in raw_texts(b)]
            yield record_batch(_SETS, [[_name(s) for s in sets], [s.view(np.int64) for s in sets]])

    made = wanted.mapInArrow(run, "sid long, shingles array<long>").join(ids, "sid", "left_semi")
    sets = tables.cut(made.groupBy("sid").agg(F.first("shingles").alias("shingles")))
    one, two = (sets.select(F.col("sid").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return tables.cut(pairs.join(two, "b").join(one, "a").where(9 * both >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"))


def near_copies(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of each doc_id of ``docs``; component_id is the smallest doc_id of the group.

    ``known`` has groups found before in the same columns; they stay together and are not compared within.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs).where(F.col("doc_id").isNotNull())
    tables = Run(docs.sparkSession)
    marked = tables.cut(marks(docs).withColumn("row", F.monotonically_increasing_id()))
    names = tables.cut(marked.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")))
    firsts = marked.join(names.select("row"), "row", "left_semi").select("sid", "n", "keys")
    keyed = firsts.select("sid", "n", F.explode("keys").alias("key"))
    sizes = tables.cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key"))
    left = tables.cut(keyed.join(sizes, "key"))
    twice = marked.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a < z").select("doc_id", "a")
    links = twice.join(marked, "doc_id").select("a", F.col("sid").alias("b"))
    if known is not None:
        named = marked.groupBy("doc_id").agg(F.min("sid").alias("sid"))
        least = named.select(F.col("doc_id").alias("component_id"), F.col("sid").alias("a"))
        together = known.where(F.col("doc_id") != F.col("component_id")).join(named, "doc_id").join(least, "component_id")
        links = links.union(together.where(F.col("a") != F.col("sid")).select("a", "sid"))
    links = tables.cut(links.distinct())
    found, tried, centres = components(links, tables), None, 1
    while True:
        placed = left.join(found, left.sid == found.id, "left").select("key", "sid", "n", F.coalesce("component", "sid").alias("c"))
        mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        left = tables.cut(_fit_to_link(tables.cut(placed.join(mixed, "key"))))
        if left.isEmpty():
            break
        part = F.pmod(F.xxhash64("sid", F.lit(centres)), F.lit(centres))
        centre = tables.cut(left.groupBy("key", part.alias("part")).agg(F.min(F.struct("sid", "n", "c", "m")).alias("hub")).select("key", "hub.*"))
        hubs = centre.select("key", F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("m").alias("m2"))
        fit = _sizes_fit() & (9 * (F.least("m", "m2") + F.ceil(4 * F.greatest("n", "n2") / 5) - 1) >= 4 * (F.col("n") + F.col("n2")))
        pairs = left.join(hubs, "key").where((F.col("c") != F.col("c2")) & fit)
        pairs = pairs.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = tables.cut(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        good = _verified(tables.cut(_can_reach(firsts, pairs)), docs, names, tables)
        links = links.unionByName(good)
        found = components(links, tables)
        left = left.select("key", "sid", "n").join(centre.select("key", "sid"), ["key", "sid"], "left_anti")
        centres *= 4
    least = names.join(found, names.sid == found.id, "left").select("sid", "doc_id", F.coalesce("component", "sid").alias("c"))
    least = tables.cut(least)
    least = least.join(least.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("sid", "component_id")
    out = cut(marked.join(least, "sid").select("doc_id", "component_id").distinct())
    tables.close()
    return out
