"""Sharding by histogram sort: shards of nearly equal bytes, ranges of one sort key.

The key is (id, row), so it never repeats.  Candidate boundaries are refined together: each round
counts the exact bytes and rows below every probe in one pass over (id, row, size), and each
boundary keeps the two probes around its target, until it is within tolerance or the probes meet.
Then one exchange brings the rows of a range together.  A shard that is larger than ``PART`` is several
ranges, so no task sorts a whole shard of a large table; the histogram's row counts make the slots gapless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quorum.llm.common import stage_table

SHARDS = 40
#: bytes of one range
PART = 256 << 20
#: a boundary may lie off its target by this share of a range's bytes
TOLERANCE = 0.001
#: probes of each boundary in a round
PROBES = 31


def places(ids: np.ndarray, rows: np.ndarray, probe_ids: np.ndarray, probe_rows: np.ndarray) -> np.ndarray:
    """For each (id, row) how many of the sorted probes aren't above it."""
    place = np.searchsorted(probe_ids, ids, "left")
    for d in np.unique(probe_ids):
        a, b = np.searchsorted(probe_ids, [d, d + 1])
        same = np.flatnonzero(ids == d)
        place[same] = a + np.searchsorted(probe_rows[a:b], rows[same], "right")
    return place


def _counted(probe_ids: np.ndarray, probe_rows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probe_ids) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            ids, row, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            place = places(ids, row, probe_ids, probe_rows)
            rows += np.bincount(place, minlength=n)
            np.add.at(size, place, weight)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], ["place", "size", "rows"])

    return run


def _part(probe_ids: np.ndarray, probe_rows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_id", "_row"))
            part = pa.array(places(ids, row, probe_ids, probe_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, part], [*batch.schema.names, "_part"])

    return run


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[tuple[tuple[int, int], int]]:
    """The parts - 1 boundaries of (_id, _row, _size) and the rows below each; to the driver come probe counts only."""
    low, high, last, total = keys.agg(F.min("_id"), F.max("_id"), F.max("_row"), F.sum("_size")).first()
    width = last + 1  # a key is one whole number: (id - low) * width + row
    count = keys.count()
    # for each boundary (key, bytes below, rows below) on both sides of its target
    around = [[(0, 0, 0), ((high - low + 1) * width, total, count)] for _ in range(parts - 1)]
    target = [total * (i + 1) // parts for i in range(parts - 1)]
    slack = tolerance * total / parts
    while True:
        probes = set()
        for t, (a, b) in zip(target, around, strict=True):
            if min(t - a[1], b[1] - t) > slack and b[0] - a[0] > 1:
                probes.update(a[0] + (b[0] - a[0]) * j // (PROBES + 1) for j in range(1, PROBES + 1))
        probes = sorted(probes - {p[0] for pair in around for p in pair})
        if not probes:
            best = [min(pair, key=lambda p, t=t: abs(p[1] - t)) for t, pair in zip(target, around, strict=True)]
            return [((p[0] // width + low, p[0] % width), p[2]) for p in best]
        at = np.array([p // width + low for p in probes], np.int64), np.array([p % width for p in probes], np.int64)
        found = keys.mapInArrow(_counted(*at), "place long, size long, rows long").groupBy("place").agg(F.sum("size"), F.sum("rows")).collect()
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for place, s, r in found:
            size[place], rows[place] = s, r
        size, rows = np.cumsum(size)[:-1], np.cumsum(rows)[:-1]
        for t, pair in zip(target, around, strict=True):
            for p, s, r in zip(probes, size.tolist(), rows.tolist(), strict=True):
                if s <= t and p > pair[0][0]:
                    pair[0] = (p, s, r)
                elif s > t and p < pair[1][0]:
                    pair[1] = (p, s, r)


def shard(df: DataFrame, id_col: str, size_col: str, shards: int = SHARDS, part: int = PART, tolerance: float = TOLERANCE) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in the shard, by id).

    Rows with the same id, a null id among them (lowest), lie in any order and may lie in several
    shards.  Null sizes count 0.  If all sizes are 0 every row counts 1.  An empty table stays empty.
    Columns named shard, slot or with a leading underscore are replaced.
    """
    names = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith("_")]
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = df.select(*names).withColumn("_id", F.coalesce(F.col(id_col).cast("long"), lowest))
    rows = stage_table(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    keys = rows.select("_id", "_row", size.alias("_size"))
    total = keys.agg(F.sum("_size")).first()[0]
    if total is None:
        return rows.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if total == 0:
        keys, total = keys.withColumn("_size", F.lit(1).cast("long")), keys.count()
    each = max(1, -(-total // (shards * part)))
    cuts = splitters(keys, shards * each, tolerance)
    at = np.array([k[0] for k, _ in cuts], np.int64), np.array([k[1] for k, _ in cuts], np.int64)
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.LongType())])
    dealt = rows.mapInArrow(_part(*at), schema)
    below = [0, *(r for _, r in cuts)]
    bases = [(i, i // each, below[i] - below[i - i % each]) for i in range(shards * each)]
    offsets = df.sparkSession.createDataFrame(bases, "_part long, shard int, _base long")  # one row per range
    number = F.row_number().over(Window.partitionBy("_part").orderBy("_id", "_row"))
    placed = dealt.withColumn("_number", number).join(F.broadcast(offsets), "_part")
    return placed.select(*names, "shard", (F.col("_base") + F.col("_number") - 1).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """The query of contract 2 over the whole table ``documents``: 40 shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(sized, "doc_id", "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
