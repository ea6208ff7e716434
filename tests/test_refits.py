"""Keyed refits against fits one by one, and other models, projections and clusterings through the same jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.operators import models
from quorum.operators.features import Preprocessor
from quorum.operators.splits import subsample, subsample_runs
from quorum.plans import refits
from quorum.plans.train import TrainConfig, cv_evaluate, cv_seeded, fit_pipeline, pairwise_run_ari, run_labels, train


def folds_of(cv):
    return {(r["seed"] if "seed" in cv.columns else 0, r["fold"]): (round(r["ari"], 9), r["n_test"]) for r in cv.collect()}


@pytest.fixture(scope="module")
def holes(blobs_df):
    """Blobs with missing values in two columns."""
    gone = ((F.col("row_index") % 7 == 0) & (F.lit(2) == F.lit(2)))
    return blobs_df.withColumn("sensors", F.transform("sensors", lambda x, i: F.when(gone & (i == 3), None).when(gone & (i == 5), float("nan")).otherwise(x)))


@pytest.mark.parametrize("mode", ["aggregates", "pca"])
def test_keyed_folds_equal_single_fits(holes, mode):
    cfg = TrainConfig(feature_mode=mode, min_samples=3, n_splits=3)
    keyed = folds_of(cv_evaluate(holes, cfg))
    assert keyed == folds_of(cv_evaluate(holes, cfg, pipeline=lambda t: fit_pipeline(t, cfg)[0])) and len(keyed) == 3


@pytest.mark.parametrize("strategy", ["median", "mean", "most_frequent"])
def test_fold_scalers_equal_the_preprocessor(holes, strategy):
    folds = refits.fold_table(holes, [1, 2], 2)
    fill, mean, scale = refits.fold_scalers(holes, folds, 4, strategy)
    for g in (0, 3):
        own = Preprocessor(strategy).fit(holes.join(folds.where(F.col("grp") == g), "row_index", "left_anti"))
        assert np.allclose(mean[g], own.mean) and np.allclose(scale[g], own.scale)
        assert np.allclose(fill[g][[3, 5]], np.array(own.fill)[[3, 5]])


def test_seeds_equal_single_runs_and_failed_projections_are_nan(blobs_df):
    cfg = TrainConfig(min_samples=3, n_splits=2)
    both = folds_of(cv_seeded(blobs_df, cfg, [1, 2]))
    assert {k: v for k, v in both.items() if k[0] == 2} == {(2, f): v for (_, f), v in folds_of(cv_evaluate(blobs_df, TrainConfig(min_samples=3, n_splits=2, seed=2))).items()}
    calls = []

    def some(train_df, all_df):
        calls.append(1)
        if len(calls) == 2:
            raise ValueError("no view of this fold")
        return all_df.select("row_index", F.slice("sensors", 1, 4).alias("features"))

    got = cv_seeded(blobs_df, cfg, [1], projection=some).collect()
    assert sorted(np.isnan(r["ari"]) for r in got) == [False, True] and sum(r["n_test"] for r in got) == 12


def test_runs_equal_single_subsamples(spark, blobs_df):
    feats = blobs_df.select("row_index", F.slice("sensors", 1, 5).alias("features"))
    runs = subsample_runs(feats, frac=0.7, n_runs=3, seed=4)
    for r in range(3):
        one = {x["row_index"] for x in subsample(feats, frac=0.7, run=r, seed=4).collect()}
        assert one == {x["row_index"] for x in runs.where(F.col("run") == r).collect()} and len(one) == 140
    cfg = TrainConfig(min_samples=3, seed=4, bootstrap_frac=0.7)
    labels = run_labels(feats, cfg, n_runs=3)
    assert labels.count() == 420
    assert pairwise_run_ari(labels).count() == 3


class Means:
    """A second kind of clusterer: k-means, novelty by distance to the centre."""

    def __init__(self, k):
        self.k = k

    def fit(self, df, vec="features"):
        self.labels = models.kmeans(df, self.k, vec=vec, n_init=2).select("row_index", "cluster_id", F.lit(1.0).alias("probability"), F.lit(0.0).alias("outlier_score"))
        rows = df.join(self.labels, "row_index").select("cluster_id", F.posexplode(vec).alias("i", "x"))
        means = {}
        for r in rows.groupBy("cluster_id", "i").agg(F.avg("x").alias("x")).collect():
            means.setdefault(r["cluster_id"], {})[r["i"]] = r["x"]
        self.centres = [[means[c][i] for i in sorted(means[c])] for c in sorted(means)]
        self.n_clusters = len(self.centres)
        return self

    def score(self, df, vec="features"):
        from quorum.functions.vectors import sq_euclidean

        d = F.array(*[F.struct(sq_euclidean(F.col(vec), F.array(*map(F.lit, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(self.centres)])
        best = F.array_min(d)
        return df.select("*", best["k"].alias("cluster_id"), F.lit(1.0).alias("strength"), (best["d"] / (best["d"] + 1)).alias("novelty"))


def test_a_second_model_runs_through_all_jobs(spark, blobs_df):
    cfg = TrainConfig(n_splits=2, n_bootstrap=2)
    make = lambda t: fit_pipeline(t, cfg, clusterer=lambda c: Means(3))[0]
    pipe = make(blobs_df)
    assert {r["predicted_label"] for r in pipe.score(blobs_df).collect()} <= {"CLASS_1", "CLASS_2", "CLASS_3", "UNKNOWN_0", "UNKNOWN_1", "UNKNOWN_2"}
    cv = cv_evaluate(blobs_df, cfg, pipeline=make)
    assert cv.count() == 2
    feats = pipe.project(blobs_df).select("row_index", "features")
    runs = run_labels(feats, cfg, cluster=lambda d: models.kmeans(d, 3, n_init=2))
    assert pairwise_run_ari(runs).count() == 1
    res = train(spark, blobs_df, cfg, run_cv=False, run_stability=False)
    assert res.internal.head()["n_points"] == 200
