"""Reading tables derived from the driver's ``embeddings`` table.

There is no sensor CSV among the test tables, so two views are derived from
``embeddings`` (vec_id contiguous, 64 float32 values, label 0-9):

* ``readings`` — all 64 values as sensors, sparse labels (classes 1-3
  on every fifth id).  No cluster structure; mostly noise is expected.
* ``blobs`` — the same keys with label-dependent centres for labels 0-4 and a
  widened, clipped background for labels 5-9, so dense groups exist.

Each view is written twice, once with DataFrame expressions and once as
DuckDB SQL text for the oracle, from the same fixed constants below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stand-in construction constants.
N_SENSORS = 64
LABELLED_CLASSES = (1, 2, 3)
LABEL_EVERY = 5
BLOB_SCALE = 0.25
BLOB_AMPLITUDE = 0.5
BLOB_LABELS_MAX = 4
BACKGROUND_SCALE = 2.0
BACKGROUND_CLIP = 0.95
AMPLIFY = 2.5


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows dealt to all cores: a file of one row group is read by one task, which would do all that follows."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(spark.sparkContext.defaultParallelism)


def _sparse_label(vec_id: Column, label: Column) -> Column:
    keep = label.isin(*LABELLED_CLASSES) & ((vec_id % LABEL_EVERY) == 0)
    return F.when(keep, label.cast("double"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_index BIGINT, sensors ARRAY<DOUBLE>, label DOUBLE)."""
    return readings_from(embeddings(spark, sf_dir))


def readings_from(e: DataFrame) -> DataFrame:
    """``readings`` expressions over any embeddings-shaped frame (batch or stream)."""
    return e.select(
        F.col("vec_id").alias("row_index"),
        F.transform("embedding", lambda x: x.cast("double")).alias("sensors"),
        _sparse_label(F.col("vec_id"), F.col("label")).alias("label"),
    )


def _blob_value(x: Column, label: Column, i: Column) -> Column:
    centre = F.lit(BLOB_SCALE) * x + F.lit(BLOB_AMPLITUDE) * F.cos((label + 1) * (i + 1))
    spread = F.least(F.lit(BACKGROUND_CLIP), F.greatest(F.lit(-BACKGROUND_CLIP), F.lit(BACKGROUND_SCALE) * x))
    return F.when(label <= BLOB_LABELS_MAX, centre).otherwise(spread)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured variant: (row_index, sensors, label) with real dense groups."""
    return blobs_from(embeddings(spark, sf_dir))


def blobs_from(e: DataFrame) -> DataFrame:
    """``blobs`` expressions over any embeddings-shaped frame (batch or stream)."""
    return e.select(
        F.col("vec_id").alias("row_index"),
        F.transform("embedding", lambda x, i: _blob_value(x.cast("double"), F.col("label"), i)).alias("sensors"),
        _sparse_label(F.col("vec_id"), F.col("label")).alias("label"),
    )


def amplified_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide layout ('Sensor 0'.. + 'Label') at 2.5x the scale with raw labels.

    Used to exercise validation: part of the values leave the allowed band and
    labels outside {1,2,3} fail the domain check.
    """
    e = embeddings(spark, sf_dir)
    cols = [F.col("vec_id").alias("row_index")]
    cols += [(F.lit(AMPLIFY) * F.col("embedding")[i].cast("double")).alias(f"Sensor {i}") for i in range(N_SENSORS)]
    cols.append(F.col("label").cast("double").alias("Label"))
    return e.select(*cols)


def readings_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide layout of ``readings`` (row_index, 'Sensor 0'.., 'Label')."""
    r = readings(spark, sf_dir)
    return r.select("row_index", *[F.col("sensors")[i].alias(f"Sensor {i}") for i in range(N_SENSORS)], F.col("label").alias("Label"))


# ---------------------------------------------------------------- SQL (DuckDB)

def _sql_label() -> str:
    classes = ", ".join(str(c) for c in LABELLED_CLASSES)
    return f"CASE WHEN label IN ({classes}) AND vec_id % {LABEL_EVERY} = 0 THEN CAST(label AS DOUBLE) END"


def readings_sql() -> str:
    vals = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(N_SENSORS))
    return f"SELECT vec_id AS row_index, list_value({vals}) AS sensors, {_sql_label()} AS label FROM embeddings"


def blobs_sql() -> str:
    def v(i: int) -> str:
        x = f"CAST(embedding[{i + 1}] AS DOUBLE)"
        centre = f"{BLOB_SCALE} * {x} + {BLOB_AMPLITUDE} * cos((label + 1) * {i + 1})"
        spread = f"least({BACKGROUND_CLIP}, greatest(-{BACKGROUND_CLIP}, {BACKGROUND_SCALE} * {x}))"
        return f"CASE WHEN label <= {BLOB_LABELS_MAX} THEN {centre} ELSE {spread} END"

    vals = ", ".join(v(i) for i in range(N_SENSORS))
    return f"SELECT vec_id AS row_index, list_value({vals}) AS sensors, {_sql_label()} AS label FROM embeddings"


def amplified_wide_sql() -> str:
    cols = ", ".join(f'{AMPLIFY} * CAST(embedding[{i + 1}] AS DOUBLE) AS "Sensor {i}"' for i in range(N_SENSORS))
    return f'SELECT vec_id AS row_index, {cols}, CAST(label AS DOUBLE) AS "Label" FROM embeddings'


def readings_wide_sql() -> str:
    cols = ", ".join(f'sensors[{i + 1}] AS "Sensor {i}"' for i in range(N_SENSORS))
    return f'SELECT row_index, {cols}, label AS "Label" FROM ({readings_sql()})'


def label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible clustering for label-map checks: cluster_id = label - 1
    (label 0 becomes the noise group -1), with the sparse ``readings`` labels."""
    e = embeddings(spark, sf_dir)
    return e.select(
        F.col("vec_id").alias("row_index"),
        (F.col("label") - 1).cast("int").alias("cluster_id"),
        _sparse_label(F.col("vec_id"), F.col("label")).alias("label"),
    )


# ---------------------------------------------------------------- contested votes and missing values

#: Modulus that makes a row noise, class that no cluster may name, gaps in the readings.
MIXED_NOISE_EVERY = 11
UNLABELLED_CLASS = 9
GAP_EVERY = 13


def mixed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustering whose clusters hold several classes: contested votes, low purity, an unlabelled cluster, noise with labels."""
    vec_id, label = F.col("vec_id"), F.col("label")
    cluster = (F.when(vec_id % MIXED_NOISE_EVERY == 0, -1).when(label == UNLABELLED_CLASS, 7)
               .otherwise((label * 3 + vec_id % 4) % 7).cast("int"))
    return embeddings(spark, sf_dir).select(vec_id.alias("row_index"), cluster.alias("cluster_id"), _sparse_label(vec_id, label).alias("label"))


def mixed_clusters_sql() -> str:
    return (f"SELECT vec_id AS row_index, CAST(CASE WHEN vec_id % {MIXED_NOISE_EVERY} = 0 THEN -1 WHEN label = {UNLABELLED_CLASS} THEN 7 "
            f"ELSE (label * 3 + vec_id % 4) % 7 END AS INTEGER) AS cluster_id, {_sql_label()} AS label FROM embeddings")


def gappy_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``readings`` without every 13th value along the diagonals: half of the gaps NULL, half NaN."""
    gap = lambda x, i: (F.when((F.col("row_index") + i) % (2 * GAP_EVERY) == 0, F.lit(None).cast("double"))
                        .when((F.col("row_index") + i) % (2 * GAP_EVERY) == GAP_EVERY, F.lit(float("nan"))).otherwise(x))
    return readings(spark, sf_dir).withColumn("sensors", F.transform("sensors", gap))


def gappy_long_sql() -> str:
    """(row_index, i, x) of ``gappy_readings`` with both kinds of gaps as NULL."""
    return (f"SELECT row_index, i, CASE WHEN (row_index + i) % {GAP_EVERY} <> 0 THEN x END AS x FROM (SELECT row_index, unnest(sensors) AS x, "
            f"unnest(generate_series(0, len(sensors) - 1)::INTEGER[]) AS i FROM ({readings_sql()}))")
