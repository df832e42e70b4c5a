"""Order-preserving packing of documents into training windows by dynamic programming.

The documents of one input split, in their order, form a token stream.  A window
is a run of at most ``size`` tokens of it, and windows end at document ends, at
sentence ends, or one full window after such an end.
The cost of a cut plan is the padding of its windows plus ``sentence_penalty``
for each cut inside a document at a sentence end and ``token_penalty`` for each
other cut inside a document.  With c(i) the least cost up to cut i,

    c(j) = penalty(j) + size - j + min { c(i) + i : j - size <= i < j }

so the minimum slides over the cuts and a monotone queue gives it in constant
time.  The stream is solved in stretches of about ``HORIZON`` tokens that end at a
document; a stretch's last window stays open and moves into the next stretch, so
memory stays bounded by a stretch and its longest document.  Only the very last
window of a split may be short; as windows of a power of two need no padding, it is cut
into such windows.

There is no shuffle: each split is packed where it is read, and losing an executor
repeats only its splits.  The order within a split must be repeatable, as it is
for a table read from files.

Nulls: a null text is an empty document (its end id is still packed); a null
doc_id is kept and packed like any other; repeated rows are packed each.  An empty table
gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assayframe.llm.common import record_batch, small_batches, texts
from assayframe.llm.tokens import word_ids

SIZE = 2048
END = 1
SENTENCE_PENALTY = 4
TOKEN_PENALTY = 24
HORIZON = 1 << 18
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64())]
)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def cut_points(ends: np.ndarray, sentences: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts allowed in a stream and the kind of each: 0 document end, 1 sentence end, 2 any other token."""
    cuts = np.union1d(ends, sentences)
    before = np.concatenate([[0], cuts[:-1]])
    wide = np.flatnonzero(cuts - before > size)
    full = np.concatenate([[size], cuts + size, *(np.arange(before[k] + size, cuts[k], size) for k in wide)])
    full = np.setdiff1d(full[full < ends[-1]], cuts)
    kinds = np.concatenate([np.where(np.isin(cuts, ends, assume_unique=True), 0, 1), np.full(len(full), 2)])
    cuts = np.concatenate([cuts, full])
    order = np.argsort(cuts, kind="stable")
    return cuts[order], kinds[order]


def best_windows(cuts: np.ndarray, kinds: np.ndarray, size: int = SIZE, penalties: tuple = (0, SENTENCE_PENALTY, TOKEN_PENALTY)) -> list[int]:
    """Cuts of the cheapest plan that ends at the last cut."""
    at = [0, *cuts.tolist()]
    fee = [0, *(penalties[k] for k in kinds.tolist())]
    key = [0] * len(at)  # cost up to a cut plus its position
    back = [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - size:
            queue.popleft()
        best = queue[0]
        back[j] = best
        mine = key[j] = fee[j] + size + key[best]  # cost(j) + here
        while queue and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    plan, j = [], len(at) - 1
    while j:
        plan.append(at[j])
        j = back[j]
    return plan[::-1]


class _Packer:
    """Packs one split; yields columns of pieces."""

    def __init__(self, size: int, penalties: tuple, stops: np.ndarray, first: int):
        self.size, self.penalties, self.stops, self.sequence = size, penalties, stops, first
        self.docs: list[tuple[int, int, int]] = []  # doc_id, tokens of the document before the buffer, tokens of the document
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[list]:
        self.docs.append((doc_id, 0, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= HORIZON:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[list]:
        if not self.held:
            return
        stream = np.concatenate(self.parts)
        ends = np.cumsum([len(p) for p in self.parts])
        sentences = np.flatnonzero(np.isin(stream, self.stops)) + 1
        plan = best_windows(*cut_points(ends, sentences[sentences < ends[-1]], self.size), self.size, self.penalties)
        if last:
            begin = plan[-2] if len(plan) > 1 else 0
            rest, plan = plan[-1] - begin, plan[:-1]
            while rest:
                step = 1 << (rest.bit_length() - 1) if rest < self.size else self.size
                begin, rest = begin + step, rest - step
                plan.append(begin)
        else:
            plan = plan[:-1]
        if plan:
            yield self.pieces(stream, ends, np.array(plan))
        kept = plan[-1] if plan else 0
        self.keep(stream, ends, kept)

    def keep(self, stream: np.ndarray, ends: np.ndarray, kept: int) -> None:
        """Go on with what follows ``kept``."""
        k = int(np.searchsorted(ends, kept, side="right"))
        docs, parts = self.docs[k:], self.parts[k:]
        if docs:
            gone = len(parts[0]) - (int(ends[k]) - kept)
            parts[0] = parts[0][gone:].copy()
            docs[0] = (docs[0][0], docs[0][1] + gone, docs[0][2])
        self.docs, self.parts, self.held = docs, parts, len(stream) - kept

    def pieces(self, stream: np.ndarray, ends: np.ndarray, plan: np.ndarray) -> list:
        """One row for each part of a document in a window."""
        starts = np.concatenate([[0], ends[:-1]])
        window = np.concatenate([[0], plan[:-1]])
        lo = np.union1d(starts[starts < plan[-1]], window)
        hi = np.append(lo[1:], plan[-1])
        doc = np.searchsorted(ends, lo, side="right")
        seq = np.searchsorted(plan, lo, side="right")
        ids = stream.astype("<u4")
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(lo.tolist(), hi.tolist())]
        names = [self.docs[d] for d in doc.tolist()]
        columns = [
            [n[0] for n in names], lo - starts[doc] + np.array([n[1] for n in names]), hi - lo, crc, [n[2] for n in names],
            self.sequence + seq, lo - window[seq], (plan - window)[seq],
        ]
        self.sequence += len(plan)
        return columns


def stop_ids(path: str) -> np.ndarray:
    """Ids of tokens that end a sentence."""
    vocab = word_ids(path).whole.get_vocab(True)
    return np.array(sorted(i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")), np.int64)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, sentence_penalty: int = SENTENCE_PENALTY, token_penalty: int = TOKEN_PENALTY) -> DataFrame:
    """One row per piece: where it lies in its document and in its window (sequence).

    ``sequence_id`` counts windows within a split, with the split's number in the upper bits.
    """
    small_batches(docs.sparkSession)
    penalties = (0, sentence_penalty, token_penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_ids(tokenizer)
        packer = _Packer(size, penalties, stop_ids(tokenizer), TaskContext.get().partitionId() << 36)
        closing = np.array([end], store.kind)
        for b in batches:
            names = iter(b.column("doc_id").to_pylist())
            for ids, lengths in store.ids(b.column("text")):
                for doc_id, own in zip(islice(names, len(lengths)), np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                    for columns in packer.add(doc_id, np.concatenate([own, closing])):
                        yield record_batch(_PIECES, columns)
        for columns in packer.flush(True):
            yield record_batch(_PIECES, columns)

    return texts(docs).mapInArrow(run, _DDL)
