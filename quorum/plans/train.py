"""Training, scoring and evaluation jobs (M1-M5, H3-H5, L1-L4).

Each job is a short sequence of distributed Spark steps; the driver holds
fitted parameters bounded by the table's width and the label map, one row a
cluster.  Tables that later steps read again are written once.
"""

from __future__ import annotations

import logging
import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.functions.names import clip01, name_to_code
from quorum.operators.density import DensityModel
from quorum.operators.features import AggregatesReducer, PCAReducer, Preprocessor, build_reducer
from quorum.operators.labelmap import apply_names, build_label_map
from quorum.operators.metrics import internal_metrics
from quorum.operators.neighbors import labeled_neighbors, neighbor_lists
from quorum.session import stored

log = logging.getLogger(__name__)

MODEL_SCHEMA_VERSION = "1.0.0"


@dataclass
class TrainConfig:
    """Defaults follow the reference settings (seed 42, mcs 10, ms 5, eom, thresholds 0.7 / 0.6)."""

    feature_mode: str = "aggregates"
    variance_target: float | None = 0.95
    n_components: int | None = None
    imputer_strategy: str = "median"
    min_cluster_size: int = 10
    min_samples: int = 5
    cluster_selection_method: str = "eom"
    weighted_votes: bool = True
    purity_warning: float = 0.6
    glosh_threshold: float = 0.7
    top_neighbors: int = 3
    n_splits: int = 5
    n_bootstrap: int = 30
    bootstrap_frac: float = 0.8
    seed: int = 42
    model_version: str = "0.1.0"


@dataclass
class ClusterPipeline:
    """Fitted pipeline: preprocessor -> reducer -> density model -> names (L1)."""

    preprocessor: Preprocessor
    reducer: AggregatesReducer | PCAReducer
    density: Clusterer
    label_map: pd.DataFrame
    labelled_refs: DataFrame | None = None      # row_index, features, label (training rows with a label)
    glosh_threshold: float = 0.7
    top_neighbors: int = 3
    trained_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    model_version: str = "0.1.0"
    purity_warning: float = 0.6

    def project(self, df: DataFrame, col: str = "sensors") -> DataFrame:
        s = self.preprocessor.transform(df, col, out="scaled")
        return self.reducer.transform(s, "scaled", out="features").drop("scaled")

    def label_map_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.label_map, schema=LABEL_MAP_STRUCT)

    def score(self, df: DataFrame, *, with_neighbors: bool = False, col: str = "sensors") -> DataFrame:
        """M2: (row_index, predicted_label, confidence, novelty_score, cluster_id, is_novel[, top_neighbors])."""
        spark = df.sparkSession
        proj = self.project(df.select("row_index", col), col).select("row_index", "features")
        scored = self.density.score(proj)
        named = apply_names(scored, self.label_map_df(spark))
        is_novel = (F.col("novelty") >= F.lit(self.glosh_threshold)) | (F.col("cluster_id") == -1)
        out = named.select(
            "row_index", "predicted_label", F.col("strength").alias("confidence"), F.col("novelty").alias("novelty_score"),
            "cluster_id", is_novel.alias("is_novel"))
        if with_neighbors:
            if self.labelled_refs is None or self.top_neighbors <= 0:
                out = out.withColumn("top_neighbors", F.array().cast(NEIGHBORS_TYPE))
            else:
                nb = labeled_neighbors(proj, self.labelled_refs, self.top_neighbors)
                lists = neighbor_lists(nb)
                out = out.join(lists, "row_index", "left").withColumn(
                    "top_neighbors", F.coalesce("top_neighbors", F.array().cast(NEIGHBORS_TYPE)))
        return out


NEIGHBORS_TYPE = T.ArrayType(T.StructType([
    T.StructField("row_index", T.LongType()), T.StructField("label", T.StringType()), T.StructField("distance", T.DoubleType())]))

LABEL_MAP_STRUCT = T.StructType([
    T.StructField("cluster_id", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("is_known", T.BooleanType()), T.StructField("is_noise", T.BooleanType()),
    T.StructField("purity", T.DoubleType()), T.StructField("n_labeled", T.IntegerType()),
    T.StructField("n_total", T.IntegerType()),
    T.StructField("label_distribution", T.MapType(T.StringType(), T.IntegerType())),
])


def _lm_pandas(lm: DataFrame) -> pd.DataFrame:
    """The label map has one row per cluster (n / min_cluster_size at most)."""
    pdf = lm.toPandas()
    pdf["label_distribution"] = pdf["label_distribution"].map(lambda m: dict(m) if m is not None else {})
    return pdf.sort_values("cluster_id").reset_index(drop=True)


class Clusterer(Protocol):
    """L1: what the pipeline needs of a clusterer.

    ``fit`` takes (row_index, features, ...) and returns the fitted object, whose ``labels`` are
    (row_index, cluster_id, probability, outlier_score) with -1 for noise; ``score`` adds cluster_id,
    strength and novelty to a table of rows.
    """

    n_clusters: int
    labels: DataFrame

    def fit(self, df: DataFrame, vec: str = "features") -> Clusterer: ...

    def score(self, df: DataFrame, vec: str = "features") -> DataFrame: ...


def density_model(cfg: TrainConfig) -> DensityModel:
    return DensityModel(min_cluster_size=cfg.min_cluster_size, min_samples=cfg.min_samples,
                        cluster_selection_method=cfg.cluster_selection_method)


def fit_pipeline(df: DataFrame, cfg: TrainConfig, *, col: str = "sensors", clusterer: Callable[[TrainConfig], Clusterer] = density_model,
                 ) -> tuple[ClusterPipeline, DataFrame]:
    """Fit preprocessor, reducer, clusterer and label map on ``df``.

    Returns the pipeline and the training table (row_index, label, features, cluster_id,
    probability, outlier_score), written once so that later evaluation steps reuse it.
    """
    base = df.select("row_index", col, "label")
    pre = Preprocessor(cfg.imputer_strategy).fit(base, col)
    scaled = pre.transform(base, col, out="scaled")
    red = build_reducer(cfg.feature_mode, variance_target=cfg.variance_target, n_components=cfg.n_components).fit(scaled, "scaled")
    feats = red.transform(scaled, "scaled", out="features").select("row_index", "label", "features")
    feats = stored(feats, "features")
    model = clusterer(cfg).fit(feats)
    train_tbl = stored(feats.join(model.labels, "row_index"), "training")
    lm = build_label_map(train_tbl, weighted=cfg.weighted_votes)
    refs = feats.where(F.col("label").isNotNull()).select("row_index", "features", "label")
    pipe = ClusterPipeline(pre, red, model, _lm_pandas(lm), refs, cfg.glosh_threshold, cfg.top_neighbors,
                           model_version=cfg.model_version, purity_warning=cfg.purity_warning)
    return pipe, train_tbl


# ---------------------------------------------------------------------- evaluation

def grouped_ari(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """E9 per group: ``keys`` + (ari, n); one contingency count and tagged marginals, no joins."""
    k = [F.col(c) for c in keys]
    cont = df.groupBy(*k, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda c: c.cast("double") * (c.cast("double") - 1) / 2.0
    tagged = (cont.select(*keys, F.lit("c").alias("t"), "n")
              .unionByName(cont.groupBy(*keys, "__a").agg(F.sum("n").alias("n")).select(*keys, F.lit("a").alias("t"), "n"))
              .unionByName(cont.groupBy(*keys, "__b").agg(F.sum("n").alias("n")).select(*keys, F.lit("b").alias("t"), "n")))
    j = tagged.groupBy(*keys).agg(
        F.sum(F.when(F.col("t") == "c", c2(F.col("n")))).alias("sc"),
        F.sum(F.when(F.col("t") == "c", F.col("n"))).alias("n"),
        F.sum(F.when(F.col("t") == "a", c2(F.col("n")))).alias("sa"),
        F.sum(F.when(F.col("t") == "b", c2(F.col("n")))).alias("sb"))
    total = c2(F.col("n"))
    exp = F.when(total > 0, F.col("sa") * F.col("sb") / total).otherwise(0.0)  # one row: no pairs
    mx = (F.col("sa") + F.col("sb")) / 2.0
    val = F.when((mx - exp) == 0, F.lit(1.0)).otherwise((F.col("sc") - exp) / (mx - exp))
    return j.select(*keys, val.alias("ari"), F.col("n").cast("long").alias("n"))


def cv_evaluate(df: DataFrame, cfg: TrainConfig, *, n_splits: int | None = None, col: str = "sensors",
                pipeline: Callable[[DataFrame], ClusterPipeline] | None = None) -> DataFrame:
    """H3: per fold refit everything on all other rows (unlabelled included), score the
    held-out labelled rows, encode names (J2) and take the ARI against the labels.

    Returns (fold, ari, n_test).  All folds are groups of one job; with a ``pipeline`` factory (L2),
    which fits a pipeline of any kind on the training rows, folds are fits of their own.
    """
    from quorum.operators.splits import fold_frames
    from quorum.plans.refits import cross_validate, fold_table

    k = n_splits or cfg.n_splits
    if pipeline is None:
        return cross_validate(df, cfg, [cfg.seed], k, col=col).select("fold", "ari", "n_test")
    folds = fold_table(df, [cfg.seed], k)
    parts = []
    for f in range(k):
        train_df, test = fold_frames(df, folds, f)
        pred = pipeline(train_df).score(test.select("row_index", col), col=col).join(test.select("row_index", "label"), "row_index")
        coded = pred.select(F.lit(f).alias("fold"), name_to_code(F.col("predicted_label")).alias("code"), "label")
        parts.append(grouped_ari(coded, ["fold"], "code", "label"))
    return stored(reduce(DataFrame.unionByName, parts).select("fold", "ari", F.col("n").alias("n_test")), "cv")


def cv_seeded(df: DataFrame, cfg: TrainConfig, seeds: list[int], *, n_splits: int | None = None,
              projection: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """H5: CV repeated over seeds (the fold assignment changes with the seed):
    (seed, fold, ari, n_test); summarise with ``seeded_summary``.

    ``projection`` (L4) takes the training rows and all rows of a refit and returns (row_index,
    features) of all rows; a refit whose projection raises ValueError has a NaN.  The density model
    still fits all refits in one job.
    """
    from quorum.operators.splits import fold_frames
    from quorum.plans.refits import cross_validate, fold_table

    k = n_splits or cfg.n_splits
    if projection is None:
        return cross_validate(df, cfg, seeds, k)
    folds = fold_table(df, seeds, k)
    parts = []
    for g in range(len(seeds) * k):
        own = folds.where(F.col("grp") == g).select("row_index", F.lit(True).alias("held"))
        train_df, _ = fold_frames(df, own.withColumn("fold", F.lit(0)), 0)
        try:
            view = projection(train_df, df).select("row_index", "features")
        except ValueError as exc:
            log.warning("projection of refit %d failed: %s", g, exc)
            continue
        rows = view.join(df.select("row_index", "label"), "row_index").join(own, "row_index", "left")
        parts.append(rows.select(F.lit(g).cast("long").alias("grp"), "row_index", F.col("label").cast("double").alias("label"),
                                 F.coalesce("held", F.lit(False)).alias("held"), "features"))
    if not parts:
        return folds.groupBy("seed", "fold").agg(F.lit(float("nan")).alias("ari"), F.count(F.lit(1)).alias("n_test"))
    return cross_validate(df, cfg, seeds, k, features=stored(reduce(DataFrame.unionByName, parts), "projections"), folds=folds)


def seeded_summary(cv: DataFrame) -> DataFrame:
    """E16 over seeds: NaN-skipping per-seed mean, then mean / population std / min / max."""
    v = F.when(~F.isnan("ari"), F.col("ari"))
    per = cv.groupBy("seed").agg(F.avg(v).alias("seed_ari"))
    return per.agg(F.avg("seed_ari").alias("mean_ari"), F.stddev_pop("seed_ari").alias("std_ari"),
                   F.min("seed_ari").alias("min_ari"), F.max("seed_ari").alias("max_ari"), F.count(F.lit(1)).alias("n_seeds"))


def cv_summary(cv: DataFrame) -> DataFrame:
    """NaN-skipping mean and population std of fold ARIs."""
    v = F.when(~F.isnan("ari"), F.col("ari"))
    return cv.agg(F.avg(v).alias("mean_ari"), F.stddev_pop(v).alias("std_ari"), F.count(F.lit(1)).cast("int").alias("n_folds"))


def run_labels(feats: DataFrame, cfg: TrainConfig, *, n_runs: int | None = None, frac: float | None = None,
               cluster: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """H4 step 1: refit only the clustering on each subsample of the projected table;
    (run, row_index, cluster_id).  The density model fits all runs in one job; ``cluster`` (L3) takes a
    subsample and returns its (row_index, cluster_id)."""
    from quorum.operators.splits import subsample_runs
    from quorum.plans import refits

    n = n_runs if n_runs is not None else cfg.n_bootstrap
    frac = frac or cfg.bootstrap_frac
    if cluster is None:
        return refits.run_labels(feats, cfg, n, frac)
    runs = stored(subsample_runs(feats, frac=frac, n_runs=n, seed=cfg.seed), "runs")
    labels = [cluster(runs.where(F.col("run") == r).drop("run")).select(F.lit(r).alias("run"), "row_index", "cluster_id") for r in range(n)]
    return reduce(DataFrame.unionByName, labels)


def pairwise_run_ari(runs: DataFrame) -> DataFrame:
    """H4 step 2 (D8, D9): ARI over the shared rows of every run pair i < j with >= 2
    shared rows; noise is a class.  One self-join on row_index — each row meets at
    most n_runs^2 / 2 pairs (a parameter, not the data size)."""
    a = runs.select(F.col("run").alias("i"), "row_index", F.col("cluster_id").alias("ca"))
    b = runs.select(F.col("run").alias("j"), "row_index", F.col("cluster_id").alias("cb"))
    j = a.join(b, "row_index").where(F.col("i") < F.col("j"))
    return grouped_ari(j, ["i", "j"], "ca", "cb").where(F.col("n") >= 2)


def stability_summary(pairs: DataFrame) -> DataFrame:
    """(stability_mean_ari, stability_std_ari, n_pairs); NULL and 0 without pairs."""
    return pairs.agg(F.avg("ari").alias("stability_mean_ari"), F.stddev_pop("ari").alias("stability_std_ari"),
                     F.count(F.lit(1)).cast("int").alias("n_pairs"))


@dataclass
class TrainResult:
    pipeline: ClusterPipeline
    training: DataFrame
    label_map: DataFrame
    internal: DataFrame
    cv: DataFrame | None
    cv_summary: DataFrame | None
    stability: DataFrame | None
    stability_pairs: DataFrame | None
    warnings: list[str]
    run_id: str
    bundle_path: str | None = None


def train(spark: SparkSession, df: DataFrame, cfg: TrainConfig | None = None, *, output_dir: str | None = None,
          tracking_dir: str | None = None, run_cv: bool = True, run_stability: bool = True) -> TrainResult:
    """M1: fit, name, measure (internal, CV, stability), persist; CV and stability
    failures only warn, as do tracking failures."""
    from quorum.operators.labelmap import low_purity_warnings

    cfg = cfg or TrainConfig()
    with ThreadPoolExecutor(2) as beside:  # CV needs the rows only: its jobs fill the gaps between the fit's
        folds = beside.submit(cv_evaluate, df, cfg) if run_cv else None
        pipe, train_tbl = fit_pipeline(df, cfg)
        resampled = beside.submit(lambda: stored(run_labels(train_tbl.select("row_index", "features"), cfg), "runs")) if run_stability and cfg.n_bootstrap > 1 else None
        lm = pipe.label_map_df(spark)
        internal = internal_metrics(train_tbl, "features", "cluster_id")
        warnings = [r["message"] for r in low_purity_warnings(lm, cfg.purity_warning).collect()]
        cv = cvs = None
        if folds:
            try:
                cv = folds.result()
                cvs = cv_summary(cv)
            except ValueError as exc:
                warnings.append(f"CV skipped: {exc}")
        stab = pairs = None
        if resampled:
            try:
                pairs = pairwise_run_ari(resampled.result())
                stab = stability_summary(pairs)
            except ValueError as exc:
                warnings.append(f"Stability skipped: {exc}")
    run_id = uuid.uuid4().hex
    res = TrainResult(pipe, train_tbl, lm, internal, cv, cvs, stab, pairs, warnings, run_id)
    if output_dir:
        from quorum.sources.bundle import save_pipeline

        res.bundle_path = save_pipeline(pipe, output_dir)
    if tracking_dir:
        try:
            from quorum.plans.report import log_run

            log_run(spark, tracking_dir, res, cfg)
        except Exception as exc:  # noqa: BLE001 - tracking never aborts training
            log.warning("run tracking failed: %s", exc)
    return res


def score_files(spark: SparkSession, pipeline: ClusterPipeline, input_path: str, output_path: str | None = None, *,
                require_label: bool = True, **layout) -> DataFrame:
    """M3: load + validate, score, write parquet/CSV; returns the prediction table.

    ``layout`` (prefix, n_sensors, label_column, ...) goes to ``load_readings``.
    """
    from quorum.sources.readers import load_readings
    from quorum.sources.sinks import write_predictions

    df = load_readings(spark, input_path, require_label=require_label, **layout)
    pred = pipeline.score(df)
    if output_path:
        write_predictions(pred, output_path)
        pred = spark.read.parquet(output_path) if output_path.endswith(".parquet") else pred
    return pred


def score_payloads(pipeline: ClusterPipeline, payloads: DataFrame, *, with_neighbors: bool = True) -> DataFrame:
    """M4: score JSON payload rows (request_id, rows) with clipped confidence and novelty."""
    from quorum.sources.readers import payload_rows

    width = len(pipeline.preprocessor.mean)
    rows = payload_rows(payloads, width)
    # payloads hold at most PAYLOAD_MAX_ROWS rows, so (request_id, position) packs into one exact key
    keyed = rows.withColumn("__key", F.struct("request_id", "row_index"))
    keyed = keyed.withColumn("row_index", F.col("request_id").cast("long") * F.lit(PAYLOAD_KEY_STRIDE) + F.col("row_index"))
    scored = pipeline.score(keyed.select("row_index", "sensors"), with_neighbors=with_neighbors)
    back = keyed.select("row_index", "__key").join(scored, "row_index")
    return back.select(F.col("__key.request_id").alias("request_id"), F.col("__key.row_index").alias("row_index"),
                       "predicted_label", clip01(F.col("confidence")).alias("confidence"),
                       clip01(F.col("novelty_score")).alias("novelty_score"), "cluster_id", "is_novel",
                       *(["top_neighbors"] if with_neighbors else []))


PAYLOAD_KEY_STRIDE = 16384


def clusters(pipeline: ClusterPipeline, spark: SparkSession) -> DataFrame:
    """Cluster listing ordered by id."""
    return pipeline.label_map_df(spark).orderBy("cluster_id")


def bundle_info(pipeline: ClusterPipeline, spark: SparkSession) -> DataFrame:
    """M8: model identity."""
    lm = pipeline.label_map
    n_clusters = int((~lm.is_noise).sum())
    n_unknown = int((~lm.is_known & ~lm.is_noise).sum())
    return spark.createDataFrame([(pipeline.model_version, pipeline.trained_at, n_clusters, n_unknown, MODEL_SCHEMA_VERSION,
                                   pipeline.glosh_threshold, pipeline.top_neighbors)],
                                 "model_version string, trained_at string, n_clusters int, n_unknown int, "
                                 "schema_version string, glosh_threshold double, top_neighbors int")


def _isnan(x) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))
