"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of code points.  All blocks are sorted, and each gets
its rank among the distinct blocks as an integer name.  Then adjacent pairs of names are named the
same way, until one name is left for each document.  Two documents with the same number of pairing
rounds and the same last name are equal texts: equality of names is equality of content at every
level, so no hash has to be trusted.

The sort order is (hash of the block, block), and the exchange is by ranges of (hash, document,
position): sampling its bounds moves three numbers a row, not texts, and a block that a third of all
rows share is split over many partitions.  The ranks of the partitions are joined through one small
row each (number of distinct keys, first key, last key).  If two blocks with one hash meet at a
border between partitions, the sort is done again with another hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.llm.common import WHITE, stage_table, texts, with_row_key

#: code points in a block
BLOCK = 2048


def _ranked(keys: list[str], carry: list[str]):
    """Arrow function over one sorted partition: rank of each row's key, then one row of facts about the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, first, last, schema = TaskContext.get().partitionId(), -1, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = None
            for col in cols:
                differs = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1))
                new = differs if new is None else pc.or_(new, differs)
            head = tuple(col[0].as_py() for col in cols)
            starts = pa.concat_arrays([pa.array([head != last], pa.bool_()), new])
            ranks = pc.add(pc.cumulative_sum(pc.cast(starts, pa.int64())), pa.scalar(rank, pa.int64()))
            rank = ranks[-1].as_py()
            first, last = head if first is None else first, tuple(col[-1].as_py() for col in cols)
            n, schema = batch.num_rows, [col.type for col in cols]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            nothing = [pa.nulls(n, t) for t in schema]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([part] * n, pa.int32()), ranks, pa.nulls(n, pa.int64()), *nothing, *nothing],
                [*carry, "part", "rank", "distinct", *(f"first_{k}" for k in keys), *(f"last_{k}" for k in keys)])
            types = [c.type for c in kept]
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, t) for t in types), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()),
                 pa.array([rank + 1], pa.int64()), *(pa.array([v], t) for v, t in zip(first, schema, strict=True)),
                 *(pa.array([v], t) for v, t in zip(last, schema, strict=True))],
                [*carry, "part", "rank", "distinct", *(f"first_{k}" for k in keys), *(f"last_{k}" for k in keys)])

    return run


def name_sorted(df: DataFrame, keys: list[str], carry: list[str], ties: list[str]) -> DataFrame:
    """Replace the key columns by ``name``: the rank of the row's key among all distinct keys.

    ``ties`` end the sort key, so that rows of one key may lie in several partitions.  To the driver
    comes one row for each partition; the key itself is never larger than a block or two names.
    """
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField(c, fields[c].dataType) for c in carry]
        + [T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("distinct", T.LongType())]
        + [T.StructField(f"{p}_{k}", T.LongType() if k == "hash" else fields[k].dataType) for p in ("first", "last") for k in ["hash", *keys]])
    needed = df.select(*dict.fromkeys([*keys, *carry]))
    for seed in itertools.count():
        hashed = needed.withColumn("hash", F.xxhash64(F.lit(seed), *keys)).repartitionByRange("hash", *ties)
        ordered = hashed.sortWithinPartitions("hash", *keys, *ties)
        ranked = stage_table(ordered.mapInArrow(_ranked(["hash", *keys], carry), schema), "ranked")
        bases, base, before = [], 0, (None,)
        for row in ranked.where("distinct is not null").orderBy("part").collect():
            first, last = (tuple(row[f"{p}_{k}"] for k in ["hash", *keys]) for p in ("first", "last"))
            if before[0] == first[0] and before != first:
                break
            base -= before == first  # the key goes on from the partition before
            bases.append((row["part"], base))
            base, before = base + row["distinct"], last
        else:
            break
    offsets = df.sparkSession.createDataFrame(bases, "part int, base long")
    named = ranked.where("distinct is null").join(F.broadcast(offsets), "part")
    return named.select(*carry, (F.col("base") + F.col("rank")).alias("name"))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, h, text_sha256, level, name) for (doc_id, text, h): equal (level, name) means equal normalised text."""
    norm = docs.select("doc_id", "h", F.regexp_replace("text", WHITE, " ").alias("norm"))
    norm = norm.withColumn("row", F.monotonically_increasing_id())
    cut = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block), F.lit(0))
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut)
    facts = F.struct("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    blocks = norm.select("row", facts.alias("facts"), cut.alias("blocks"))
    blocks = blocks.select("row", "facts", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    at_start = F.col("pos") == 0
    blocks = blocks.select("row", "pos", "n", "block", *(F.when(at_start, F.col(f"facts.{c}")).alias(c) for c in ("doc_id", "h", "text_sha256")))
    carry = ["row", "pos", "n", "doc_id", "h", "text_sha256"]
    level, done = 0, []
    names = name_sorted(blocks, ["block"], carry, ["row", "pos"])
    while True:
        done.append(names.where("n = 1").select("row", "doc_id", "h", "text_sha256", F.lit(level).alias("level"), "name"))
        left = names.where("n > 1")
        if left.isEmpty():
            break
        even = F.col("pos") % 2 == 0
        pairs = left.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("one"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("two"),
            F.ceil(F.max("n") / 2).cast("int").alias("n"), *(F.max(c).alias(c) for c in ("doc_id", "h", "text_sha256")))
        names, level = name_sorted(pairs, ["one", "two"], carry, ["row", "pos"]), level + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, h (hash of the raw text).

    Texts are equal when they are identical after each run of white space is one space.  Null counts
    as empty, and all empty texts are one group.  Of a group the row with the smallest doc_id stays
    (a null doc_id is larger than any other); of rows repeated with that doc_id, one.  An empty table
    gives no rows; other columns of ``docs`` aren't read.
    """
    ids = identities(with_row_key(texts(docs, id_col, text_col)), block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("keep")
    groups = ids.groupBy("level", "name").agg(first, F.count(F.lit(1)).alias("group_size"))
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "h")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns stay.

    Repeated rows (same doc_id and text) are one row afterwards.  (doc_id, hash of the text) leads
    from the verdict back to the row; partial aggregation removes repeats before the exchange.
    """
    kept = exact_dedup(docs).where("kept").select("doc_id", "h")
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("_key", key).dropDuplicates(["doc_id", "_key"])
    match = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["_key"] == kept["h"])
    return rows.join(kept, match, "left_semi").drop("_key")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The query of contract 9 over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).drop("h")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
