"""Token ids in files: each document compressed for itself with a shared zstandard dictionary.

The file format is a folder with two Parquet tables: ``dictionary`` (hash, bytes) and ``blocks``.  A
block holds the documents of a range of ids: their ids, numbers of tokens and offsets, the payload
(one zstandard frame per document, little-endian unsigned 32-bit ids) and the dictionary's hash.  To read
one short document, Parquet's statistics lead to its block and the offsets to its frame.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm.common import texts
from quorum.llm.packing import END_ID, tokenizer_text
from quorum.llm.word_ids import chunk_cache, slices
from quorum.session import checkpoint_dir

#: the dictionary is trained on this many documents at most, and on this many characters of each
SAMPLE, SAMPLE_CHARS = 1000, 8000
DICTIONARY = 64 << 10
LEVEL = 3
#: documents, and bytes of payload, after which a block ends
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20

_BLOCKS = ("shard int, block int, first_id long, last_id long, tokens_before long, tokens long, dictionary string, "
           "doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary")


def _serialized(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_cache(shared.value)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            ids, begins = cache.encode(docs)
            rows = [np.append(ids[i:j], end_id).astype("<u4").tobytes() for i, j in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    return run


def train_dictionary(docs: DataFrame, shared, end_id: int = END_ID) -> bytes:
    """Shared dictionary from at most SAMPLE documents, chosen by hash; empty if they are too few or too alike to train on."""
    import zstandard

    hashed = docs.select(F.xxhash64("doc_id").alias("h"))  # reads no text
    last = hashed.orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    start = F.substring("text", 1, SAMPLE_CHARS)
    some = docs.where(F.xxhash64("doc_id") <= F.lit(last)).select(F.xxhash64("doc_id").alias("h"), start.alias("text")).orderBy("h").limit(SAMPLE).select("text")
    samples = [bytes(r[0]) for r in some.mapInArrow(_serialized(shared, end_id), "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def _write(shared, trained, end_id: int):
    name = hashlib.sha256(trained.value).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, compress = chunk_cache(shared.value), _compressor(trained.value).compress
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, frames, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)])
            known = [d for d in doc_ids if d is not None] or [None]
            row = [shard, block, min(known), max(known), before, sum(counts), name, doc_ids, counts, offsets.tolist(), b"".join(frames)]
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [f.split()[0] for f in _BLOCKS.split(", ")])

        for batch in batches:
            ids_here, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(docs):
                ids, begins = cache.encode(docs[a:b])
                for doc, i, j in zip(ids_here[a:b], begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    own = np.append(ids[i:j], end_id).astype("<u4")
                    doc_ids.append(doc)
                    counts.append(len(own))
                    frames.append(compress(own.tobytes()))
                    size += len(frames[-1])
                    if len(frames) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield made()
                        block, before = block + 1, before + sum(counts)
                        doc_ids, counts, frames, size = [], [], [], 0
        if frames:
            yield made()

    return run


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Write the token ids of all rows to the folder ``path``, by ascending doc_id (null ids first, repeated ids in any order).

    The exchange is by ranges of (doc_id, row), so rows that share an id may lie in several files.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    trained = spark.sparkContext.broadcast(train_dictionary(rows, shared, end_id))
    table = [(hashlib.sha256(trained.value).hexdigest(), bytearray(trained.value))]
    spark.createDataFrame(table, "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    ordered.select("doc_id", "text").mapInArrow(_write(shared, trained, end_id), _BLOCKS).write.parquet(f"{path}/blocks")


def _read(trained, only: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress, name = _decompressor(trained.value).decompress, hashlib.sha256(trained.value).hexdigest()
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("the block was written with another dictionary")
                doc_ids, begin, found = [], [], []
                at = row["before"]
                for k, (doc, n) in enumerate(zip(row["doc_ids"], row["n_tokens"], strict=True)):
                    if only is None or doc == only:
                        a, b = row["offsets"][k : k + 2]
                        doc_ids.append(doc)
                        begin.append(at)
                        found.append(decompress(row["payload"][a:b]))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "start", "ids"])

    return run


def _digested(inner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            rows = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r) for r in rows], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """Blocks with ``before``, the ids in all blocks before; to the driver comes one row per file."""
    trained = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"]))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals, before = [], 0
    for row in blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens")).orderBy("shard").collect():
        totals.append((row["shard"], before))
        before += row["tokens"]
    offsets = spark.createDataFrame(totals, "shard int, shard_before long")
    blocks = blocks.join(F.broadcast(offsets), "shard").withColumn("before", F.col("shard_before") + F.col("tokens_before"))
    return blocks, trained


_NEEDED = ["doc_ids", "n_tokens", "offsets", "payload", "dictionary", "before"]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document, ids as little-endian unsigned 32-bit integers."""
    blocks, trained = _blocks(spark, path)
    return blocks.select(*_NEEDED).mapInArrow(_read(trained), "doc_id long, start long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, start, ids) of one document; only its frames are decompressed, and blocks of other ids aren't read."""
    blocks, trained = _blocks(spark, path)
    blocks = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return blocks.select(*_NEEDED).mapInArrow(_read(trained, doc_id), "doc_id long, start long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    blocks, trained = _blocks(spark, path)
    return blocks.select(*_NEEDED).mapInArrow(_digested(_read(trained)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_id_files(spark, sf_dir: str) -> DataFrame:
    """The query of contract 5 over the whole table ``documents``: writes the files to the shared folder and reads them back."""
    path = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(spark, path)
