"""Ranked lexical search by the Best Position Algorithm over impact lists.

A first pass counts terms: for each document its length and its counts of the items' terms, written as a table, from
which document count, total length and document frequencies follow.  A second pass deals the documents into blocks; in a
block each term has its list of documents by falling impact (weight times saturated count), and each item is searched in
it.  Lists are read from the top in steps; every document met is looked up in all lists of the item by direct accesses,
which tell its whole score and its position in each list.  The best position of a list is the last one up to which every
position has been seen, in whatever way; the impacts there add up to the most that an unseen document can score, and the
search of a block ends once that sum is strictly below the k-th score found so far, in this block or earlier ones of the
partition.  What is strictly below can't tie, so equal scores are ordered by doc_id exactly.  The best k of the
partitions are ranked together; a document is in one block only, so nothing is lost.

All arithmetic but the logarithm is on 64-bit integers.  Items are searched in groups of about ``GROUP_BYTES`` of text,
one group after another, so that what each task is sent is bounded; blocks hold about ``BLOCK`` counts.

Nulls: a null text has no terms; an item without terms, or with terms that no document has, gives no rows.  Documents
without doc_id count in the statistics but can't be named in the result.  Rows that repeat a doc_id are documents of
their own, as are rows of items that repeat an item_id.  Empty tables give no rows.  Long texts are counted in pieces.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import raw_texts, record_batch, small_batches, texts
from assayframe.session import Run, cut

BEST = 20
GROUP_BYTES = 4 << 20
#: Counts of terms in one block, and positions read from each list in the first step.
BLOCK = 1 << 22
STEP = 32
PIECE = 1 << 20
#: Groups in which the best of the partitions are ranked first.
SALTS = 64
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text: runs of digits, letters (A-Z lower-cased) and non-ASCII characters."""
    text, found, at = text.translate(_LETTERS), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class ImpactLists:
    """The lists of one block: for each term its rows by falling impact, and each row's position there."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        row = np.repeat(np.arange(len(lengths)), sizes)
        keep = weights[terms] > 0
        row, terms, tfs = row[keep], terms[keep], tfs[keep]
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * lengths[row]))
        self.starts = np.searchsorted(np.sort(terms), np.arange(len(weights) + 1))
        by_impact = np.lexsort((-impact, terms))
        by_row = np.argsort(terms, kind="stable")
        place = np.empty(len(terms), np.int64)
        place[by_impact] = np.arange(len(terms)) - self.starts[terms[by_impact]]
        self.rows, self.impacts = row[by_impact], impact[by_impact]  # by impact
        self.row, self.impact, self.place = row[by_row], impact[by_row], place[by_row]  # by row
        self.n_rows = len(lengths)

    def search(self, wanted: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the block's best documents for an item's terms with their repeats.

        ``least``: score that is to be reached, if k better or equal ones are known already, else 0.
        """
        lists = [(self.starts[t], self.starts[t + 1], times) for t, times in wanted if self.starts[t] < self.starts[t + 1]]
        met = np.zeros(self.n_rows, bool)
        seen = [np.zeros(b - a + 1, bool) for a, b, _ in lists]  # the last one is never seen
        best = [0] * len(lists)  # positions up to here have all been seen
        read, step = [0] * len(lists), STEP
        rows, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while True:
            new = []
            for j, (a, b, _) in enumerate(lists):
                at = max(read[j], best[j])
                read[j] = min(at + step, b - a)
                new.append(self.rows[a + at : a + read[j]])
            new = np.unique(np.concatenate(new)) if new else np.empty(0, np.int64)
            new = new[~met[new]]
            met[new] = True
            total = np.zeros(len(new), np.int64)
            for j, (a, b, times) in enumerate(lists):  # direct accesses
                own = self.row[a:b]
                at = np.minimum(np.searchsorted(own, new), b - a - 1)
                hit = own[at] == new
                at = at[hit]
                total[hit] += times * self.impact[a:b][at]
                seen[j][self.place[a:b][at]] = True
                best[j] += int(np.argmin(seen[j][best[j] :]))
            rows.append(new)
            scores.append(total)
            all_rows, all_scores = np.concatenate(rows), np.concatenate(scores)
            if len(all_scores) >= k:
                least = max(least, int(np.partition(all_scores, -k)[-k]))
            keep = all_scores >= max(least, 1)
            rows, scores = [all_rows[keep]], [all_scores[keep]]
            unseen = [(a, b, times, p) for (a, b, times), p in zip(lists, best, strict=True) if p < b - a]
            most = sum(times * int(self.impacts[a + max(p, 1) - 1]) for a, b, times, p in unseen)
            if not unseen or most < least:
                return rows[0], scores[0]
            step *= 2


def _searched(items: list[list[tuple[int, int]]], weights: np.ndarray, documents: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple[int, int]]] = [[] for _ in items]  # (-score, doc_id) of the best so far

        def block(parts: list) -> None:
            ids, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*parts, strict=True))
            lists = ImpactLists(75 + 25 * n * documents // total, sizes, terms, tfs, weights)
            for i, wanted in enumerate(items):
                rows, scores = lists.search(wanted, k, -top[i][-1][0] if len(top[i]) >= k else 0)
                if len(rows):
                    order = np.lexsort((ids[rows], -scores))[:k]
                    top[i] = sorted([*top[i], *zip((-scores[order]).tolist(), ids[rows[order]].tolist(), strict=True)])[:k]

        parts, held = [], 0
        for b in batches:
            terms, tfs = b.column("terms"), b.column("tfs")
            sizes = np.diff(terms.offsets.to_numpy())
            parts.append((b.column("doc_id").to_numpy(), b.column("n").to_numpy(), sizes, terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            held += len(parts[-1][3])
            if held >= BLOCK:
                block(parts)
                parts, held = [], 0
        if parts:
            block(parts)
        rows = [(i, d, -s) for i, found in enumerate(top) for s, d in found]
        if rows:
            yield record_batch(_FOUND, zip(*rows, strict=True))

    return run


def _counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its length, and its counts of known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), raw_texts(b), strict=True):
                if found := term_counts(text):
                    held = sorted((known[t], tf) for t, tf in found.items() if t in known)
                    out.append((doc_id, found.total(), [t for t, _ in held], [tf for _, tf in held]))
            if out:
                yield record_batch(_COUNTS, zip(*out, strict=True))

    return texts(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _rank(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item, among the best k of the partitions."""

    def best(df: DataFrame, *by: str) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id"))
        return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)

    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return best(best(salted, "item", "salt").drop("rank", "salt"), "item")


def _search_group(docs: DataFrame, items: list[tuple], k: int, tables: Run) -> DataFrame | None:
    """(item_id, rank, doc_id, score) for some items; None where none has a term."""
    counts = [(i, term_counts((t or "").encode())) for i, t in items]
    known = {t: k for k, t in enumerate(sorted({t for _, c in counts for t in c}))}
    if not known:
        return None
    counted = tables.cut(_counted(docs, known))
    seen = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    if not seen["documents"]:
        return None
    holding = np.zeros(len(known), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # at most len(known)
        holding[r["t"]] = r["df"]
    weights = np.array([weight(seen["documents"], int(df)) for df in holding], np.int64)
    wanted = [sorted((known[t], times) for t, times in c.items() if weights[known[t]] > 0) for _, c in counts]
    rows = counted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
    found = rows.mapInArrow(_searched(wanted, weights, seen["documents"], int(seen["total"]), k), "item int, doc_id long, score long")
    names = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id long")
    return tables.cut(_rank(found, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))


def _groups(items: DataFrame, tables: Run) -> Iterable[list[tuple]]:
    """Items in groups of about ``GROUP_BYTES``, one at a time on the driver."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // GROUP_BYTES
    parted = tables.cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("part")))
    for part in range(n):
        rows = parted.where(F.col("part") == part).select("item_id", "text").collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) its k best documents with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Run(spark)
    found = [x for group in _groups(items, tables) if (x := _search_group(docs, group, k, tables)) is not None]
    if not found:
        tables.close()
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = cut(reduce(DataFrame.unionByName, found))
    tables.close()
    return out
