"""Packing documents into sequences by best-fit decreasing.

A document longer than a sequence is cut into full windows, which fill a sequence each.  The rests,
longest first, go to the open window with the least room that still holds them; a segment tree over
the possible amounts of room finds it.  Documents are dealt to groups by hash; each group is
packed for itself, so padding arises only in the last windows of a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum.llm.common import small_batches, stage_table, texts
from quorum.llm.word_ids import chunk_cache, slices

LENGTH = 4096
#: documents of one packing group
GROUP = 20_000
END_ID = 2
#: characters that are encoded at a time
SLICE = 1 << 20


def tokenizer_text(path: str | None, name: str = "word_bpe_49k.json") -> str:
    """Content of a tokenizer file, read once on the driver (a few MB at most) and sent with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _tokens(shared, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_cache(shared.value)
        for batch in batches:
            docs = batch.column(1).to_pylist()
            for a, b in slices(docs, SLICE):
                ids, begins = cache.encode(docs[a:b])
                counts, sums = [], []
                for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    own = np.append(ids[i:j], end_id).astype("<u4")
                    counts.append(len(own))
                    sums.append([zlib.crc32(own[s : s + length].tobytes()) for s in range(0, len(own), length)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "sums"])

    return run


class TightestWindow:
    """Segment tree over amounts of room: how many open windows have so much, and which.

    ``take(size)`` goes up from the leaf of ``size`` to the first subtree to the right that holds an
    open window, then down to its leftmost leaf.
    """

    def __init__(self, length: int):
        self.leaves = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for ``size``; none if there is none."""
        node = size + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: nothing further right below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each item, items given longest first, and the number of windows."""
    tree, windows = TightestWindow(length), 0
    window, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        found = tree.take(size)
        if found is None:
            found, windows = (length, windows), windows + 1
        room, window[i] = found
        offset[i] = length - room
        if room > size:
            tree.put(room - size, int(window[i]))
    return window, offset, windows


def _pack(length: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        pieces = frame["sums"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(frame)), pieces)
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        tokens = frame["doc_tokens"].to_numpy()[owner]
        size = np.minimum(length, tokens - begin)
        order = np.lexsort((begin, owner, -size))
        window, offset, _ = best_fit_decreasing(size[order], length)
        owner, begin = owner[order], begin[order]
        sums = np.concatenate([np.asarray(s, np.int64) for s in frame["sums"]])[order]
        return pd.DataFrame({
            "doc_id": frame["doc_id"].iloc[owner].astype("Int64").to_numpy(dtype=object, na_value=None), "start": begin, "length": size[order],
            "ids_crc32": sums, "doc_tokens": tokens[order], "grp": np.int64(key[0]), "window": window, "offset": offset})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer_path: str | None = None,
         end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's.  Sequences are
    numbered from 0 without gaps; ``padded_to`` is ``length``, or the sequence's own number of tokens
    where that is a power of two.  A null text is empty and gives one piece with the end id.  Repeated
    rows and null ids are packed like any others; an empty table gives no rows; other columns of
    ``docs`` aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    made = texts(docs, id_col, text_col).mapInArrow(_tokens(shared, length, end_id), "doc_id long, doc_tokens long, sums array<long>")
    with small_batches(docs.sparkSession):
        made = stage_table(made.withColumn("row", F.monotonically_increasing_id()), "tokens")
    groups = max(1, -(-made.count() // group))
    dealt = made.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    pieces = dealt.groupBy("grp").applyInPandas(
        _pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, window long, offset long")
    pieces = stage_table(pieces, "pieces")
    # one row per group: its first sequence number
    counts = pieces.groupBy("grp").agg((F.max("window") + 1).alias("windows"))
    before = F.sum("windows").over(Window.orderBy("grp")) - F.col("windows")
    numbered = pieces.join(counts.select("grp", before.alias("before")), "grp").withColumn("sequence_id", F.col("before") + F.col("window"))
    filled = numbered.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    filled = filled.withColumn("padded_to", F.when(F.col("filled").bitwiseAND(F.col("filled") - 1) == 0, F.col("filled")).otherwise(F.lit(length)))
    return numbered.join(filled, "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("padded_to").cast("long").alias("padded_to"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """The query of contract 6 over the whole table ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
