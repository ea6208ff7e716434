import os
import tempfile
import time

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quorum.plans.train import TrainConfig, fit_pipeline
from quorum.sources import stand_ins as si
from quorum.sources.bundle import current_version, load_pipeline, save_pipeline


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0 and "cluster_id" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bundle_incomplete_version_is_ignored(spark, blobs_df):
    pipe, _ = fit_pipeline(blobs_df, TrainConfig(min_samples=3))
    d = tempfile.mkdtemp(prefix="quorum-bundle-", dir="/tmp")
    save_pipeline(pipe, d)
    # a crashed save: tables of version 2 exist but no completion marker
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{d}/v=2/preprocessor")
    assert current_version(spark, d) == 1
    p2 = load_pipeline(spark, d)
    a = pipe.score(blobs_df).orderBy("row_index").toPandas()
    b = p2.score(blobs_df).orderBy("row_index").toPandas()
    assert (a.cluster_id == b.cluster_id).all()
    save_pipeline(pipe, d)
    assert current_version(spark, d) == 3


def test_scoring_is_partition_independent_and_fast(spark, blobs_df):
    pipe, _ = fit_pipeline(blobs_df, TrainConfig(min_samples=3))
    a = pipe.score(blobs_df).orderBy("row_index").toPandas()
    b = pipe.score(blobs_df.repartition(5)).orderBy("row_index").toPandas()
    assert (a.cluster_id.to_numpy() == b.cluster_id.to_numpy()).all()
    assert np.allclose(a.novelty_score, b.novelty_score)
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.uniform(-0.9, 0.9, 20)]) for i in range(1000)]
    perf = spark.createDataFrame(rows, "row_index long, sensors array<double>")
    pipe.score(perf).count()  # warm
    t = time.time()
    assert pipe.score(perf).count() == 1000
    assert time.time() - t < 5.0


def test_stream_equals_batch(spark):
    from quorum.streaming.score_stream import embeddings_stream, score_stream

    b = si.blobs(spark, SF_SMALL)
    pipe, _ = fit_pipeline(b, TrainConfig(min_samples=3))
    q, ok, bad = score_stream(spark, pipe, si.blobs_from(embeddings_stream(spark, SF_SMALL)).drop("label"))
    q.awaitTermination()
    s = spark.read.parquet(ok).drop("batch_id").orderBy("row_index").toPandas()
    bt = pipe.score(b).orderBy("row_index").toPandas()
    assert len(s) == len(bt)
    assert (s.predicted_label.to_numpy() == bt.predicted_label.to_numpy()).all()
    assert spark.read.parquet(bad).count() == 0
