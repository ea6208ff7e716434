"""Helpers shared by the text operators: stage tables, input columns, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.session import checkpoint_dir

#: The white space of the contract, as regular expressions.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: rows of an Arrow batch where a row is a text
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs that run inside hand Python at most ``rows`` rows at a time: both a worker and its JVM hold a whole batch.

    The session's own bound holds if it is lower, and again afterwards.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(own) <= 0 else min(int(own), rows)))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation of what stands
    above.  The folder is shared by driver and executors; the cluster expires it like checkpoints.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only the two columns are read, so other columns never clash; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``h``, a hash of the text: (doc_id, h) names a row's content wherever the table is read again."""
    return df.withColumn("h", F.xxhash64("text"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (node, root), root the smallest node reachable.

    Smallest labels travel along the links and along the labels themselves (pointer jumping) until
    nothing changes.  Each round is two joins on one row per node or link, with partial minima
    before the shuffle, and ends in a written table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage_table(both.where("a <> b").distinct(), "links")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    label = stage_table(label, "labels-0")
    number = 0
    while True:
        number += 1
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = label.join(near, label.node == near.a, "left").select(
            "node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        far = label.select(F.col("node").alias("low"), F.col("root").alias("far"))
        step = lower.join(far, "low", "left").select(
            "node", F.least("low", F.coalesce("far", "low")).alias("root"), F.col("root").alias("was"))
        step = stage_table(step, f"labels-{number}")
        label = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return label
