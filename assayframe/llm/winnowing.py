"""Document fingerprints by winnowing, and the likeness of a text to an edited version and to its neighbour.

Every run of ``GRAM`` code points is hashed (a polynomial over the code points, built by doubling, then mixed), and of
each window of ``WINDOW`` consecutive hashes the smallest is chosen, the rightmost one of equal ones.  The chosen hashes
with their positions are the fingerprint; a hash chosen by several windows at one position stands once.  Any passage of
``GRAM + WINDOW - 1`` code points that two texts share makes both choose the same hash inside it.  A text shorter than
``GRAM`` is one gram, one with fewer than ``WINDOW`` grams one window.  Long texts are worked through in pieces that
overlap by a window, which gives the same choice.

``edited_fingerprints`` puts the rows in descending order of doc_id and gives each the next row's first code points in
place of its own last half; after the last row comes the first.  Rows are dealt once, by ranges of doc_id, and each range
also gets the first row of the range after it, so no window spans the table.

Nulls: a null text is an empty one, with an empty fingerprint; rows without doc_id come after all others.  Rows that
share a doc_id are ordered by a hash of their text; more than ``REPEATS`` rows that are equal in both are worked out once
and repeated.  An empty table gives no rows; in a table of one row the next one is the row itself.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import raw_texts, record_batch, small_batches, texts

GRAM = 24
WINDOW = 40
#: Code points worked through at once.
PIECE = 1 << 18
#: Equal rows (doc_id and text) that one range may hold one by one.
REPEATS = 1000
_BASE = 0x9E3779B97F4A7C15
_PRINTS = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32()))])
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("again", pa.int64()),
])


def code_points(text: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes; bytes that are none become replacement characters."""
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def utf8(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le").encode()


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` code points from each position on; ``gram`` is at most the length."""
    grown = {1: points.astype(np.uint64) + np.uint64(1)}
    size, power = 1, {1: _BASE}
    while 2 * size <= gram:
        h = grown[size]
        grown[2 * size] = h[:-size] * np.uint64(power[size]) + h[size:]
        power[2 * size] = power[size] * power[size] % (1 << 64)
        size *= 2
    out, done, left = None, 0, gram
    for s in sorted(grown, reverse=True):  # gram as a sum of powers of two
        if left >= s:
            part = grown[s][done:]
            out = part if out is None else out[: len(part)] * np.uint64(power[s]) + part
            done, left = done + s, left - s
    out = out[: len(points) - gram + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest hash of each window, the rightmost of equal ones."""
    at = np.arange(len(hashes), dtype=np.int64)
    size = 1

    def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[left] < hashes[right], left, right)

    while 2 * size <= window:
        at = merged(at[:-size], at[size:])
        size *= 2
    return at if size == window else merged(at[: size - window], at[window - size :])


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order of position."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = min(gram, n)
    window = min(window, n - gram + 1)
    hashes, positions, last = [], [], -1
    for start in range(0, n - gram - window + 2, PIECE):
        h = gram_hashes(points[start : start + PIECE + gram + window - 2], gram)
        at = _least(h, window)
        keep = np.ones(len(at), bool)
        keep[1:] = at[1:] != at[:-1]
        at = at[keep]
        at = at[at + start > last]
        if len(at):
            last = int(at[-1]) + start
            hashes.append(h[at])
            positions.append(at + start)
    return np.concatenate(hashes), np.concatenate(positions)


def as_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Sixteen hex digits for each chosen hash: its lower 32 bits and its position (both big-endian), spaces between."""
    pairs = np.stack([hashes & np.uint64(0xFFFFFFFF), positions.astype(np.uint64) & np.uint64(0xFFFFFFFF)], axis=1)
    return pairs.astype(">u4").tobytes().hex(" ", 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the chosen hashes of both fingerprints that the other has too, repeats counted; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    (a, times_a), (b, times_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return 2.0 * int(np.minimum(times_a[at_a], times_b[at_b]).sum()) / int(times_a.sum() + times_b.sum())


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions) for every row: the chosen hashes and where in the text they stand."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [winnow(code_points(t), gram, window) for t in raw_texts(b)]
            yield record_batch(_PRINTS, [b.column("doc_id"), [h.view(np.int64) for h, _ in made], [p.astype(np.int32) for _, p in made]])

    return texts(docs).mapInArrow(run, "doc_id long, hashes array<long>, positions array<int>")


def _ranges(docs: DataFrame, n: int) -> Column:
    """Range of a row (0 to n-1 in descending order of doc_id, rows without one last), of about equally many rows.

    Ids that several limits fall on (they hold much of the table) are shared out by the hash of the text.
    """
    row = docs.agg(F.count("doc_id").alias("ids"), F.count(F.lit(1)).alias("rows")).first()
    void = min(n, -(-n * (row["rows"] - row["ids"]) // max(1, row["rows"])))  # ranges of rows without an id
    full = max(1, n - void)
    limits = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [k / full for k in range(1, full)], 1 / (4 * full)) if full > 1 and row["ids"] else []
    up = np.array(sorted(~max(-(2**63), min(2**63 - 1, int(x))) for x in limits), np.int64)  # descending order

    @F.pandas_udf("int")
    def number(void_id: pd.Series, down: pd.Series, h: pd.Series) -> pd.Series:
        share = ((h.to_numpy(np.int64) >> 32) + (1 << 31)).astype(np.float64) / (1 << 32)  # 0 to 1, in the order of h
        down = down.to_numpy(np.int64)
        ahead = np.searchsorted(up, down, "left")
        within = np.minimum(ahead + np.floor(share * (np.searchsorted(up, down, "right") - ahead + 1)), full - 1)
        outside = np.minimum(full + np.floor(share * void), n - 1)
        return pd.Series(np.where(void_id, outside, within).astype(np.int32))

    return number(F.col("place.void"), F.col("place.down"), F.col("h"))


def _alike(one: tuple, two: tuple, again: int) -> tuple:
    """Result row of ``one`` = (doc_id, points, fingerprint) when ``two`` is the next."""
    doc_id, points, (hashes, positions) = one
    half = len(points) // 2
    edited = np.concatenate([points[: len(points) - half], two[1][:half]])
    got = winnow(edited)
    return (
        doc_id, len(points), hashlib.sha256(utf8(edited)).hexdigest(), as_string(hashes, positions), as_string(*got),
        likeness(hashes, got[0]), likeness(hashes, two[2][0]), again,
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order; the last one is only there to be the next of the one before it.

    A row with ``more`` stands for so many further equal ones; for them the next is their own text, which is written
    as one row with that count in ``again``.
    """
    held = None
    for b in batches:
        out = []
        for doc_id, more, extra, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "more", "extra")), raw_texts(b), strict=True):
            points = code_points(text)
            row = (doc_id, points, winnow(points))
            if held is not None:
                out.append(_alike(held, row, 0))
            held = None if extra else row
            if more and not extra:
                out.append(_alike(row, row, more))
        for k in range(0, len(out), 200):
            yield record_batch(_EDITED, zip(*out[k : k + 200], strict=True))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` and of its edited text, and their likenesses; one result row for each."""
    spark = docs.sparkSession
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").isNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), F.col("h")]
    rows = rows.select("doc_id", "h", "text", F.struct(order[0].alias("void"), order[1].alias("down"), order[2].alias("h")).alias("place"))
    rows = rows.withColumn("range", _ranges(rows, n))
    many = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REPEATS)
    repeated = not many.isEmpty()
    if not repeated:
        rows = rows.withColumn("more", F.lit(0).cast("long"))
    else:
        held = rows.join(many, "place").groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("text").alias("text"), F.first("range").alias("range"), F.first("n").alias("n"))
        held = held.select("doc_id", "h", "text", "place", "range", (F.col("n") - 1).alias("more"))
        rows = rows.join(many, "place", "left_anti").select("doc_id", "h", "text", "place", "range", F.lit(0).cast("long").alias("more")).unionByName(held)
    first = sorted(rows.groupBy("range").agg(F.min("place").alias("place")).collect(), key=lambda r: r["range"])  # at most n
    if not first:
        return spark.createDataFrame([], _ROW)
    before = [(first[k - 1]["range"], first[k]["place"]) for k in range(len(first))]
    heads = spark.createDataFrame([(r, tuple(p)) for r, p in before], "range int, place struct<void:boolean,down:long,h:long>")
    heads = rows.drop("range").join(F.broadcast(heads), "place").dropDuplicates(["range"]).withColumn("extra", F.lit(True))
    dealt = rows.withColumn("extra", F.lit(False)).unionByName(heads.select(*rows.columns, "extra"))
    dealt = dealt.select("doc_id", "text", "more", "extra", "place", "range").repartitionById(n, F.col("range")).sortWithinPartitions("extra", "place")
    out = dealt.select("doc_id", "text", "more", "extra").mapInArrow(_walk, f"{_ROW}, again long")
    if not repeated:
        return out.drop("again")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("again", F.lit(1)) - 1, F.lit(REPEATS).cast("long")))
    out = out.withColumn("from", parts).withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + REPEATS, F.greatest("again", F.lit(1))) - 1)))
    return out.drop("again", "from", "k")
