"""Token-id files: one zstandard frame per document, all with one shared dictionary.

A store is a folder with two Parquet tables, written and read by Spark so that any
file system serves and lost executors leave no half files:

* ``dictionary``: one row, the dictionary and its SHA-256;
* ``shards``: one row per shard of about ``SHARD_BYTES``: ``part`` and ``seq`` (order
  of shards), ``before`` (ids in earlier shards of the part), ``first_doc`` and
  ``last_doc``, ``dict_hash``, ``width`` (bytes of an id), ``doc_ids``, ``lengths`` (ids of each
  document), ``offsets`` (where each frame begins in ``payload``, and the end) and ``payload``.

Documents lie in ascending doc_id order.  A single document is read from its
shard's offset index alone, without touching its neighbours' frames.

The dictionary is trained on at most ``SAMPLE_DOCS`` documents (those with the
smallest hash of doc_id), of each at most ``SAMPLE_BYTES`` of its serialized ids;
every document is encoded whole.

Nulls: a null text is an empty document (only its end id); a null doc_id comes
first.  Rows that repeat a doc_id are all kept.  An empty table gives an empty store.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm.common import record_batch, small_batches, texts
from assayframe.llm.tokens import word_ids
from assayframe.session import cut

END = 2
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 1 << 15
DICTIONARY_BYTES = 1 << 16
SHARD_BYTES = 1 << 20
LEVEL = 6
_FRAMES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
_SHARDS = pa.schema(
    [("part", pa.int64()), ("seq", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
     ("dict_hash", pa.string()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
     ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())]
)
_SHARDS_DDL = ("part long, seq long, before long, n_tokens long, first_doc long, last_doc long, dict_hash string, width int, "
               "doc_ids array<long>, lengths array<long>, offsets array<long>, payload binary")
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _encoded(store, found: pa.Array, end: int) -> list[bytes]:
    closing = np.array([end], store.kind).tobytes()
    return [own.tobytes() + closing for ids, lengths in store.ids(found) for own in np.split(ids, np.cumsum(lengths)[:-1])]


def train_dictionary(docs: DataFrame, tokenizer: str, end: int = END, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of serialized id arrays of a bounded sample; empty if there is too little to learn from."""
    chosen = texts(docs).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_ids(tokenizer)
        for b in batches:
            yield record_batch(pa.schema([("ids", pa.binary())]), [[x[:SAMPLE_BYTES] for x in _encoded(store, b.column("text"), end)]])

    sample = texts(docs).join(F.broadcast(chosen), "doc_id").limit(SAMPLE_DOCS)  # the chosen ids: SAMPLE_DOCS rows at most
    samples = [bytes(r["ids"]) for r in sample.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, sorted(samples)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode every whole text and write the store at ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    dictionary = train_dictionary(docs, tokenizer, end)
    name = hashlib.sha256(dictionary).hexdigest()
    width = word_ids(tokenizer).kind.itemsize
    spark.createDataFrame([(name, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_ids(tokenizer)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(dictionary)).compress
        for b in batches:
            raw = _encoded(store, b.column("text"), end)
            yield record_batch(_FRAMES, [b.column("doc_id"), [len(r) // width for r in raw], [pack(r) for r in raw]])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids, lengths, frames = zip(*held, strict=True)
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            return record_batch(_SHARDS, [[x] for x in (part, seq, before, sum(lengths), ids[0], ids[-1], name, width, list(ids), list(lengths), offsets, b"".join(frames))])

        for b in batches:
            for item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(item)
                size += len(item[2])
                if size >= SHARD_BYTES:
                    yield row()
                    seq, before = seq + 1, before + sum(h[1] for h in held)
                    held, size = [], 0
        if held:
            yield row()

    frames = cut(texts(docs).mapInArrow(encode, "doc_id long, n_tokens long, frame binary"))
    ordered = frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")
    ordered.mapInArrow(shards, _SHARDS_DDL).write.parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    name, raw = row["dict_hash"], bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != name:
        raise ValueError("the dictionary does not match its hash")
    return name, raw


def _frames_of(row: dict, name: str, decoder: zstandard.ZstdDecompressor, wanted=None) -> Iterator[tuple[int, np.ndarray]]:
    """Documents of one shard, or only the wanted ones."""
    if row["dict_hash"] != name:
        raise ValueError("a shard was written with another dictionary")
    kind = np.dtype(f"<u{row['width']}")
    for k, doc_id in enumerate(row["doc_ids"]):
        if wanted is None or doc_id in wanted:
            frame = row["payload"][row["offsets"][k] : row["offsets"][k + 1]]
            ids = np.frombuffer(decoder.decompress(frame, max_output_size=row["lengths"][k] * kind.itemsize), kind)
            yield doc_id, ids.astype("<u4")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before."""
    name, raw = _dictionary(spark, path)
    stored = spark.read.parquet(f"{path}/shards")
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row for each written part
    base = dict(zip((r["part"] for r in totals), np.cumsum([0, *(r["n"] for r in totals)]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = zstandard.ZstdDecompressor(dict_data=_codec(raw))
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                found = [(d, len(ids), zlib.crc32(ids.tobytes())) for d, ids in _frames_of(row, name, decoder)]
                ids, lengths, crc = zip(*found, strict=True)
                first = base[row["part"]] + row["before"]
                yield record_batch(_READ, [ids, first + np.cumsum([0, *lengths[:-1]]), lengths, crc])

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: only their shards are read and only their frames decompressed."""
    name, raw = _dictionary(spark, path)
    wanted = frozenset(doc_ids)
    near = F.lit(False)
    for d in sorted(wanted):
        near = near | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = zstandard.ZstdDecompressor(dict_data=_codec(raw))
        for b in batches:
            for row in b.to_pylist():
                for d, ids in _frames_of(row, name, decoder, wanted):
                    yield record_batch(pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]), [[d], [ids.tolist()]])

    return spark.read.parquet(f"{path}/shards").where(near).mapInArrow(run, "doc_id long, ids array<long>")
