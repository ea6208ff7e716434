import tempfile

import numpy as np
from pyspark.sql import functions as F

from quorum.plans.train import TrainConfig, clusters, score_payloads, train
from quorum.sources.bundle import load_pipeline


def test_train_blobs_pca(spark, blobs_df, blob_points):
    cfg = TrainConfig(feature_mode="pca", min_cluster_size=10, min_samples=3, n_splits=3, n_bootstrap=2)
    out = tempfile.mkdtemp(prefix="quorum-test-", dir="/tmp")
    res = train(spark, blobs_df, cfg, output_dir=f"{out}/model", tracking_dir=f"{out}/track")
    assert res.internal.head()["n_clusters"] >= 2
    cv = res.cv_summary.head()
    assert cv["n_folds"] == 3
    assert cv["mean_ari"] > 0.5
    st = res.stability.head()
    assert st["n_pairs"] == 1
    lm = res.label_map.toPandas()
    assert lm["name"].str.startswith("CLASS_").any()
    # bundle round trip gives the same predictions
    pipe2 = load_pipeline(spark, f"{out}/model")
    a = res.pipeline.score(blobs_df).orderBy("row_index").toPandas()
    b = pipe2.score(blobs_df).orderBy("row_index").toPandas()
    assert (a.predicted_label == b.predicted_label).all()
    assert np.allclose(a.novelty_score, b.novelty_score)
    assert list(a.columns) == ["row_index", "predicted_label", "confidence", "novelty_score", "cluster_id", "is_novel"]
    nb = res.pipeline.score(blobs_df, with_neighbors=True).toPandas()
    assert nb.top_neighbors.map(len).eq(3).all()
    assert clusters(pipe2, spark).count() == len(lm)
    assert spark.read.parquet(f"{out}/track/run_metrics").count() > 3


def test_payload_scoring(spark, blobs_df):
    cfg = TrainConfig(feature_mode="aggregates", min_cluster_size=10, min_samples=3)
    from quorum.plans.train import fit_pipeline

    pipe, _ = fit_pipeline(blobs_df, cfg)
    payloads = spark.createDataFrame([(7, [[0.1] * 20, [-0.2] * 20, [0.5] * 20])], "request_id long, rows array<array<double>>")
    out = score_payloads(pipe, payloads).toPandas()
    assert len(out) == 3 and set(out.row_index) == {0, 1, 2}
    assert out.confidence.between(0, 1).all() and out.novelty_score.between(0, 1).all()


def test_cv_runs_beside_the_fit(spark, blobs_df, monkeypatch):
    import threading

    from quorum.plans import train as jobs

    begun, fit = threading.Event(), jobs.fit_pipeline

    def no_folds(df, cfg):
        begun.set()
        raise ValueError("no folds")

    def late(df, cfg):
        assert begun.wait(30)
        return fit(df, cfg)

    monkeypatch.setattr(jobs, "cv_evaluate", no_folds)
    monkeypatch.setattr(jobs, "fit_pipeline", late)
    res = train(spark, blobs_df, TrainConfig(min_samples=3), run_stability=False)
    assert res.cv is None and res.stability is None and "CV skipped: no folds" in res.warnings
