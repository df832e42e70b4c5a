"""Subword lattice language model: documents scored by the marginal probability of all segmentations.

The pieces are those of an existing unigram-scored vocabulary (a sentencepiece model).
Their weights are learnt from the training documents: every distinct word is segmented once
by the vocabulary's own scores and its pieces are counted, and ``PRIOR`` pseudo-counts
follow the vocabulary's order.  The training words themselves are further pieces, each an
arc over the whole word.  With N training tokens, V of them distinct, such an arc weighs c / (N + V), and
the cuts into vocabulary pieces share the weight V / (N + V), so that all probabilities add up to at most one.
The probability of a word is the sum over all ways to cut it, by a forward recursion in logarithms; characters
without a piece fall back to their bytes, so every word has one.  A document's probability is that of its words and one end.

Word counts are a shuffled table.  Only the ``COMMON`` most frequent words (short ones) go to the
tasks as a whole, everything else is joined: a word that is not among them
travels as one row for each document that has it.

Held out are documents with crc32(doc_id as text) mod 7 = 2; a null doc_id is a training document.  Nulls: a null text
is an empty one and consists of the end alone.  Repeated rows are counted and scored each.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import record_batch, small_batches, texts
from assayframe.session import Run, cut

FOLDS = 7
HELD_OUT = 2
COMMON = 50_000
COMMON_BYTES = 32
PRIOR = 32_000.0
FLUSH = 400_000
_COUNTS = pa.schema([("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())])
_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.string()), ("n", pa.int64()), ("n_known", pa.int64()),
                   ("logs", pa.float64()), ("score", pa.float64())])


def _split(b: pa.RecordBatch) -> pa.ListArray:
    return pc.ascii_split_whitespace(pc.ascii_lower(b.column("text")))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often each word stands in training documents and in all."""

    def total(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by("word").aggregate([("c", "sum"), ("n", "sum")])
        return t.select(["word", "c_sum", "n_sum"]).rename_columns(["word", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for b in batches:
            words = _split(b)
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            learn = np.repeat(~b.column("held_out").to_numpy(zero_copy_only=False), words.value_lengths().to_numpy())
            which = coded.indices.to_numpy()
            size = len(coded.dictionary)
            parts.append(pa.table([coded.dictionary, np.bincount(which, learn, size).astype(np.int64), np.bincount(which, minlength=size)], schema=_COUNTS))
            if sum(map(len, parts)) > 3 * FLUSH:
                parts = [total(parts)]
                if len(parts[0]) > FLUSH:
                    yield from parts[0].combine_chunks().to_batches(1 << 16)
                    parts = []
        if parts:
            yield from total(parts).combine_chunks().to_batches(1 << 16)

    found = docs.mapInArrow(run, "word string, c long, n long").where("word != ''")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_logs(words: DataFrame, vocabulary: str) -> tuple[dict[str, float], float]:
    """Natural logarithms of the pieces' and the end's probabilities; as many as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(vocabulary)
        counts = np.zeros(model.vocab_size())
        for b in batches:
            found = model.encode(b.column("word").to_pylist(), num_threads=1)
            counts += np.bincount(np.concatenate([np.empty(0, np.int64), *(np.array(f, np.int64) for f in found)]), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield record_batch(pa.schema([("piece", pa.int64()), ("c", pa.int64())]), [at, counts[at].astype(np.int64)])

    rows = words.where("c > 0").select("word").mapInArrow(run, "piece long, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()
    model = _pieces(vocabulary)
    size = model.vocab_size()
    order = np.argsort(np.argsort([-model.get_score(i) for i in range(size)], kind="stable"), kind="stable")
    weights = 1.0 / (order + 2.0)
    weights *= PRIOR / weights.sum()
    for r in rows:
        weights[r["piece"]] += r["c"]
    total = weights.sum() + 1
    return {model.id_to_piece(i): math.log(weights[i] / total) for i in range(size) if not (model.is_control(i) or model.is_unknown(i))}, -math.log(total)


def word_log(word: str, logs: dict[str, float], longest: int, spelt: float = 0.0, whole: float | None = None) -> float:
    """Log probability of a word: forward recursion over all segmentations.

    ``spelt``: log weight shared by the cuts into vocabulary pieces; ``whole``: that of the arc over the whole word, if there is one.
    """
    text = "▁" + word
    n = len(text)
    ways: list[list[float]] = [[] for _ in range(n + 1)]
    ways[0] = [spelt]
    if whole is not None:
        ways[n].append(whole)
    for i in range(n):
        terms = ways[i]
        if len(terms) == 1:
            here = terms[0]
        else:
            top = max(terms)
            here = top + math.log(sum(math.exp(x - top) for x in terms))
        for j in range(i + 1, min(n, i + longest) + 1):
            p = logs.get(text[i:j])
            if p is not None:
                ways[j].append(here + p)
        if text[i] not in logs:
            ways[i + 1].append(here + sum(logs[f"<0x{x:02X}>"] for x in text[i].encode()))
    top = max(ways[n])
    return top + math.log(sum(math.exp(x - top) for x in ways[n]))


def word_table(words: DataFrame, logs: dict[str, float], total: int, distinct: int) -> DataFrame:
    """``words`` with ``score``, the log10 of each word's marginal probability, from ``total`` training tokens, ``distinct`` of them different."""
    every = math.log(max(total + distinct, 1))
    spelt = math.log(distinct) - every if distinct else 0.0
    longest = max(map(len, logs))
    schema = pa.schema([*_COUNTS, ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True)
            scores = [word_log(w, logs, longest, spelt, math.log(c) - every if c else None) / math.log(10) for w, c in counted]
            yield record_batch(schema, [*b.columns, scores])

    return words.select("word", "c", "n").mapInArrow(run, "word string, c long, n long, score double")


def score_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): token counts, base score and the model's score."""
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    marked = texts(docs).withColumn("held_out", held)
    ends = marked.where("not held_out").count()
    run_tables = Run(spark)
    counted = run_tables.cut(word_counts(marked))
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = sums["c"] + ends, sums["v"] + (1 if ends else 0)
    base = math.log10(total + distinct + 1)
    logs, end_log = piece_logs(counted, vocabulary)
    table = run_tables.cut(word_table(counted, logs, total, distinct))
    top = table.where(F.octet_length("word") <= COMMON_BYTES).orderBy(F.desc("n"), "word").limit(COMMON).select("word", "c", "score").toPandas()  # COMMON rows at most
    common = dict(zip(top["word"], zip(top["c"].tolist(), top["score"].tolist())))
    end_score = math.log10((ends + distinct * math.exp(end_log)) / (total + distinct)) if distinct else end_log / math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            words = _split(b)
            sizes, flat = words.value_lengths().to_numpy(), words.flatten()
            coded = flat.dictionary_encode()
            which, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            found = [common.get(w) for w in names]
            blank = np.array([w == "" for w in names], bool)
            rare = np.array([f is None for f in found], bool) & ~blank
            c = np.array([0 if f is None else f[0] for f in found], np.int64)
            score = np.array([0.0 if f is None else f[1] for f in found])
            logs10 = np.where(rare | blank, 0.0, np.log10(c + 1) - base)
            owner = np.repeat(np.arange(b.num_rows), sizes)

            def by_doc(values: np.ndarray) -> np.ndarray:
                return np.bincount(owner, values[which], b.num_rows) if len(which) else np.zeros(b.num_rows)

            n = by_doc((~blank).astype(float)).astype(np.int64) + 1
            known = by_doc((c > 0).astype(float)).astype(np.int64) + (1 if ends else 0)
            ids = row + np.arange(b.num_rows)
            yield record_batch(_PART, [ids, b.column("doc_id"), b.column("held_out"), pa.nulls(len(ids), pa.string()), n, known,
                                       by_doc(logs10) + math.log10(ends + 1) - base, by_doc(score) + end_score])
            at = np.flatnonzero(rare[which]) if len(which) else np.empty(0, np.int64)
            if len(at):
                pair, many = np.unique(owner[at] * len(names) + which[at], return_counts=True)
                doc, word = pair // len(names), pair % len(names)
                for k in range(0, len(pair), 1 << 16):
                    s = slice(k, k + (1 << 16))
                    m = len(pair[s])
                    yield record_batch(_PART, [ids[doc[s]], pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), coded.dictionary.take(pa.array(word[s])), many[s],
                                               pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())])
            row += b.num_rows

    ddl = "row long, doc_id long, held_out boolean, word string, n long, n_known long, logs double, score double"
    parts = run_tables.cut(marked.mapInArrow(run, ddl))
    rare = parts.where("word is not null").select("row", "word", "n").join(table.select("word", "c", F.col("score").alias("s")), "word")
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * (F.log10(F.col("c") + 1) - F.lit(base))).alias("l"), F.sum(F.col("n") * F.col("s")).alias("s"))
    whole = parts.where("word is null").join(more, "row", "left")
    out = cut(whole.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("l", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score")))
    run_tables.close()
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
