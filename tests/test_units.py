import json
import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorum.functions.names import name_to_code
from quorum.operators.features import PCAReducer, Preprocessor
from quorum.operators.labelmap import build_label_map, low_purity_warnings
from quorum.operators.metrics import ari_value, internal_metrics, silhouette, silhouette_rows
from quorum.operators.quantiles import exact_quantiles, order_statistics
from quorum.operators.splits import labeled_stratified_kfold, subsample
from quorum.operators.validate import DataValidationError, payload_rejects
from quorum.plans.train import pairwise_run_ari, stability_summary
from quorum.sources.bundle import SchemaVersionError, label_map_document, label_map_from_document
from quorum.sources.readers import load_readings, with_row_index


def _cy(spark, clusters, labels):
    rows = [(i, int(c), None if (l is None or (isinstance(l, float) and math.isnan(l))) else float(l))
            for i, (c, l) in enumerate(zip(clusters, labels))]
    return spark.createDataFrame(rows, "row_index long, cluster_id int, label double")


def _lm(spark, clusters, labels, **kw):
    return {r["cluster_id"]: r.asDict() for r in build_label_map(_cy(spark, clusters, labels), **kw).collect()}


def test_majority_vote(spark):
    lm = _lm(spark, [0, 0, 0, 0, 1, 1], [1, 1, 1, None, 2, None])
    assert lm[0]["name"] == "CLASS_1" and lm[0]["purity"] == 1.0
    assert lm[1]["name"] == "CLASS_2"
    assert lm[0]["label_distribution"] == {"1.0": 3}


def test_unknown_and_noise(spark):
    lm = _lm(spark, [0, 0, 1, 1, 1], [1, 1, None, None, None])
    assert lm[1]["name"] == "UNKNOWN_1" and lm[1]["purity"] is None and lm[1]["label_distribution"] == {}
    lm = _lm(spark, [-1, -1, 0, 0], [1, None, 2, None])
    assert lm[-1]["name"] == "NOISE" and lm[-1]["is_noise"] and lm[-1]["n_labeled"] == 1 and lm[-1]["purity"] is None


def test_weighted_vote_beats_count(spark):
    clusters = [0] * 5 + [1] * 27 + [2] * 3
    labels = [1, 1, 1, 2, 2] + [1] * 27 + [2] * 3
    lm = _lm(spark, clusters, labels)
    assert lm[0]["name"] == "CLASS_2"
    assert abs(lm[0]["purity"] - 0.6) < 1e-12
    assert _lm(spark, clusters, labels, weighted=False)[0]["name"] == "CLASS_1"


def test_tie_goes_to_smaller_class_and_low_purity_warning(spark):
    assert _lm(spark, [0, 0], [2, 1])[0]["name"] == "CLASS_1"
    lm = build_label_map(_cy(spark, [0, 0, 0, 0], [1, 1, 2, 2]))
    assert low_purity_warnings(lm, 0.6).count() == 1


def test_name_codes(spark):
    df = spark.createDataFrame([("CLASS_1",), ("CLASS_42",), ("UNKNOWN_7",), ("NOISE",)], "n string")
    assert [r[0] for r in df.select(name_to_code(F.col("n"))).collect()] == [1, 42, 1007, -1]
    bad = spark.createDataFrame([("CLASS_x",)], "n string")
    with pytest.raises(Exception):
        bad.select(name_to_code(F.col("n"))).collect()


def test_preprocessor_population_std(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, size=(50, 5))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(50)], "row_index long, sensors array<double>")
    z = np.stack(Preprocessor().fit(df).transform(df).orderBy("row_index").toPandas()["scaled"].to_numpy())
    assert np.allclose(z.mean(0), 0, atol=1e-9) and np.allclose(z.std(0), 1, atol=1e-9)


def test_pca_variance_target(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 3))
    x = base @ rng.normal(size=(3, 10)) + 0.01 * rng.normal(size=(200, 10))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(200)], "row_index long, scaled array<double>")
    p = PCAReducer(variance_target=0.9).fit(df)
    assert sum(p.explained_variance_ratio) >= 0.9 and p.n_components <= 3
    with pytest.raises(ValueError):
        PCAReducer(variance_target=1.5)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 0.25)])
    df = spark.createDataFrame([("a", float(v)) for v in vals], "key string, value double")
    got = exact_quantiles(df, [0.1, 0.5, 0.9], n_buckets=8, leaf_rows=50)["a"]
    assert np.allclose(got, np.quantile(vals, [0.1, 0.5, 0.9]))
    k = order_statistics(df, [("a", 1234)], n_buckets=4, leaf_rows=10)[("a", 1234)]
    assert k == np.sort(vals)[1234]


def test_stratified_kfold(spark):
    labels = [None] * 70 + [1.0] * 10 + [2.0] * 10 + [3.0] * 10
    df = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "row_index long, label double")
    f = labeled_stratified_kfold(df, n_splits=5).toPandas()
    assert len(f) == 30 and set(f.fold) == set(range(5))
    per = f.groupby(["label", "fold"]).size().unstack()
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()
    # sub-bucketed ranks keep the invariants
    g = labeled_stratified_kfold(df, n_splits=5, max_group_rows=3).toPandas()
    per = g.groupby(["label", "fold"]).size().unstack()
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()
    few = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None), (3, None)], "row_index long, label double")
    with pytest.raises(ValueError):
        labeled_stratified_kfold(few, n_splits=5)


def test_subsample_exact_size_and_determinism(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_index")
    a = subsample(df, frac=0.7, run=1)
    assert a.count() == 700
    b = subsample(df.repartition(7), frac=0.7, run=1)
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


def test_ari_ignores_unlabelled_and_internal_metrics(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0), (2, 99, None), (3, 2, 2.0)], "row_index long, c int, label double")
    assert ari_value(df, "c", "label") == 1.0
    noise = spark.createDataFrame([(i, [float(i), 0.0, 1.0], -1) for i in range(20)], "row_index long, features array<double>, cluster_id int")
    m = internal_metrics(noise).head()
    assert m["n_clusters"] == 0 and m["noise_fraction"] == 1.0 and m["silhouette"] is None
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 0.3, (20, 2)), rng.normal(5, 0.3, (20, 2))])
    two = spark.createDataFrame([(i, [float(v) for v in pts[i]], int(i >= 20)) for i in range(40)],
                                "row_index long, features array<double>, cluster_id int")
    assert silhouette(two) > 0.5
    assert abs(silhouette(two, strategy="blocked", block_rows=7) - silhouette(two)) < 1e-9


def test_stability_perfect_agreement(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "row_index long, c int")
    runs = None
    for r in range(5):
        s = subsample(df, frac=0.7, run=r).select(F.lit(r).alias("run"), "row_index", F.col("c").alias("cluster_id"))
        runs = s if runs is None else runs.unionByName(s)
    st = stability_summary(pairwise_run_ari(runs)).head()
    assert st["n_pairs"] == 10 and abs(st["stability_mean_ari"] - 1.0) < 1e-12
    one = df.select(F.lit(0).alias("run"), "row_index", F.col("c").alias("cluster_id"))
    st = stability_summary(pairwise_run_ari(one)).head()
    assert st["n_pairs"] == 0 and st["stability_mean_ari"] is None


def _csv(tmp, rows, cols):
    p = os.path.join(tmp, "r.csv")
    pd.DataFrame(rows, columns=cols).to_csv(p, index=False)
    return p


def test_loader_validation_and_order(spark):
    tmp = tempfile.mkdtemp(prefix="quorum-test-", dir="/tmp")
    cols = [f"Sensor {i}" for i in range(20)] + ["Label"]
    good = [[0.1] * 20 + [1.0], [0.2] * 20 + [None]]
    p = _csv(tmp, good, cols)
    df = load_readings(spark, p)
    assert df.count() == 2 and df.where("label IS NULL").count() == 1
    # column order is free and extra columns are tolerated
    q = os.path.join(tmp, "shuffled.csv")
    pd.DataFrame(good, columns=cols)[list(reversed(cols))].assign(extra="x").to_csv(q, index=False)
    r = load_readings(spark, q).orderBy("row_index").collect()
    assert r[0]["sensors"][0] == 0.1
    bad = _csv(tempfile.mkdtemp(dir="/tmp"), [[99.0] + [0.0] * 19 + [1.0]], cols)
    with pytest.raises(DataValidationError):
        load_readings(spark, bad)
    with pytest.raises(FileNotFoundError):
        load_readings(spark, "/tmp/does-not-exist-quorum.csv")


def test_row_index_contiguous(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("v"))
    idx = sorted(r[0] for r in with_row_index(df).select("row_index").collect())
    assert idx == list(range(1000))


def test_payload_rejects(spark):
    rows = [
        (0, [[0.0] * 20]), (1, [[0.0] * 5]), (2, [[float("nan")] * 20]), (3, [[float("inf")] + [0.0] * 19]),
        (4, []), (5, [[1.5] * 20]), (6, [[-1.5] * 20]), (7, [[0.0] * 2000]), (8, [[0.1, 0.2, 9.0]]),
    ]
    df = spark.createDataFrame(rows, "request_id long, rows array<array<double>>")
    rej = {r["request_id"]: r["reason"] for r in payload_rejects(df, width=20).collect()}
    assert 0 not in rej and set(rej) == set(range(1, 9))


def test_label_map_document_round_trip():
    lm = pd.DataFrame([{"cluster_id": -1, "name": "NOISE", "is_known": False, "is_noise": True, "purity": float("nan"),
                        "n_labeled": 1, "n_total": 3, "label_distribution": {"1.0": 1}},
                       {"cluster_id": 0, "name": "CLASS_1", "is_known": True, "is_noise": False, "purity": 1.0,
                        "n_labeled": 2, "n_total": 5, "label_distribution": {"1.0": 2}}])
    doc = label_map_document(lm)
    assert json.loads(doc)["entries"]["-1"]["purity"] is None
    back = label_map_from_document(doc)
    assert list(back.name) == ["NOISE", "CLASS_1"] and math.isnan(back.purity[0])
    d = json.loads(doc)
    d["schema_version"] = "9.9.9"
    with pytest.raises(SchemaVersionError):
        label_map_from_document(json.dumps(d))
    del d["schema_version"]
    with pytest.raises(SchemaVersionError):
        label_map_from_document(json.dumps(d))


@pytest.mark.parametrize("bcast", [10_000, 5])
def test_pair_distance_medians_match_numpy(spark, bcast):
    from quorum.operators.pairdist import within_between

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    lab = np.repeat([1.0, 2.0, 3.0, None], 10)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], lab[i]) for i in range(40)],
                               "row_index long, features array<double>, label double")
    got = {r["class"]: r for r in within_between(df, max_broadcast_rows=bcast, block_rows=7).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for c in (1.0, 2.0, 3.0):
        i = np.nonzero(lab == c)[0]
        o = np.nonzero((lab != c) & (lab != None))[0]  # noqa: E711
        w = d[np.ix_(i, i)][~np.eye(len(i), dtype=bool)]
        assert abs(got[c]["within_median"] - np.median(w)) < 1e-12
        assert abs(got[c]["between_median"] - np.median(d[np.ix_(i, o)])) < 1e-12


def test_sensor_columns_by_prefix_and_number(spark):
    from quorum.sources.readers import columns_by_prefix

    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "`Sensor 10` int, `Sensor 2` int, `Sensor note` int, other int, `Sensor 0` int")
    assert columns_by_prefix(df) == ["Sensor 0", "Sensor 2", "Sensor 10"] and columns_by_prefix(df, "none") == []


def test_label_map_document_keeps_the_purity_limit(spark, tmp_path):
    import pandas as pd

    from quorum.sources.bundle import label_map_document, load_label_map, purity_warning_from_document, save_label_map

    lm = pd.DataFrame([(0, "CLASS_1", True, False, 0.7, 3, 9, {"1.0": 3}), (-1, "NOISE", False, True, None, 0, 2, {})],
                      columns=["cluster_id", "name", "is_known", "is_noise", "purity", "n_labeled", "n_total", "label_distribution"])
    save_label_map(spark, lm, str(tmp_path / "lm"), 0.75)
    back, limit = load_label_map(spark, str(tmp_path / "lm"))
    assert limit == 0.75 and list(back.cluster_id) == [-1, 0]
    assert purity_warning_from_document(label_map_document(lm).replace('"purity_warning": 0.6, ', "")) == 0.6


def test_missing_report_is_told_from_other_errors(spark, tmp_path):
    from quorum.plans.report import read_report

    with pytest.raises(FileNotFoundError):
        read_report(spark, str(tmp_path), "internal")
    (tmp_path / "report_internal").mkdir()
    (tmp_path / "report_internal" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception) as err:  # noqa: PT011
        read_report(spark, str(tmp_path), "internal").collect()
    assert not isinstance(err.value, FileNotFoundError)


def test_silhouette_in_runs_of_a_joined_table(spark):
    """Beyond the bound the two sides of a table made by a join were ambiguous."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(3 * c, 1, (n, 3)) for c, n in enumerate((30, 9, 1, 5, 17))])
    x[31] = x[30]
    cl = np.repeat([4, 2, 9, 0, 7], [30, 9, 1, 5, 17])
    rows = spark.createDataFrame([(int(i) // 2, int(i), [float(v) for v in x[i]], int(cl[i])) for i in range(len(x))],
                                 "row_index long, i long, features array<double>, cluster_id int")
    joined = rows.select("row_index", "i", "features").join(rows.select("i", "cluster_id"), "i")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(len(x)):
        own = cl == cl[i]
        a, b = d[i, own].sum() / max(own.sum() - 1, 1), min(d[i, cl == c].mean() for c in set(cl) if c != cl[i])
        want.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    for kw in ({}, {"strategy": "blocked", "block_rows": 7}, {"strategy": "blocked", "block_rows": 20}, {"max_broadcast_points": 12}):
        got = sorted(r["s"] for r in silhouette_rows(joined, **kw).collect())  # row_index repeats
        assert np.allclose(got, sorted(want), atol=1e-9), kw


def test_silhouettes_of_views_in_runs(spark):
    from quorum.operators.fit_scores import score_fits

    rng = np.random.default_rng(9)
    data = [(g, i, None, [float(v) for v in rng.normal(4 * (i % 2), 1, 2 + g)], i % 2 if i else -1) for g in range(4) for i in range(40)]
    t = spark.createDataFrame(data, "grp long, row_index long, label double, features array<double>, cluster_id int")
    labels, views = t.select("grp", "row_index", "cluster_id"), t.select("grp", "row_index", "label", "features")
    whole, runs, single = (sorted((r["grp"], round(r["silhouette"], 9)) for r in score_fits(labels, views, broadcast_bytes=b).collect())
                           for b in (1 << 20, 6000, 0))
    assert whole == runs == single and len(whole) == 4


def test_distances_of_a_product_are_those_of_differences():
    from quorum.operators.nearest import ClusterSums, distances

    rng = np.random.default_rng(10)
    for scale, away in ((1.0, 0.0), (1e-4, 1e5), (1e200, 0.0)):
        x = rng.normal(0, scale, (500, 5)) + away
        x[7], x[8, 2] = x[6], np.nan
        cluster = rng.integers(-1, 90, 500)
        with np.errstate(over="ignore", invalid="ignore"):
            d = distances(x[:40], x)
            for k in (90, 3):
                own = np.where(cluster < k, cluster, -1)
                got, = ClusterSums(x, [(own, k)]).of(x[:40])
                want = np.stack([d[:, own == c].sum(axis=1) for c in range(k)], axis=1)
                assert np.allclose(got, want, rtol=1e-9, equal_nan=True)
