import numpy as np
import pytest

from quorum.operators.density import DensityModel
from quorum.operators.condensing import condense
from quorum.operators.density import fit_groups, score_groups
from quorum.operators.spanning import spanning_tree, with_core

import dense_hierarchy as dense


def _two_d_blobs():
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [10, 10], [-10, 5]], dtype=float)
    return np.vstack([c + rng.normal(0, 0.4, size=(40, 2)) for c in centres])


def _df(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_index long, features array<double>")


def test_three_blobs_found(spark):
    x = _two_d_blobs()
    m = DensityModel(min_cluster_size=10, min_samples=5).fit(_df(spark, x))
    lab = m.labels.toPandas().sort_values("row_index")
    assert m.n_clusters == 3
    assert (lab.cluster_id >= 0).sum() > 100
    # each blob maps to one cluster
    for b in range(3):
        ids = lab.cluster_id.to_numpy()[b * 40:(b + 1) * 40]
        ids = ids[ids >= 0]
        assert len(set(ids)) == 1
    assert lab.probability.between(0, 1).all()
    assert lab.outlier_score.between(0, 1).all()


def test_scoring_far_points_and_training_agreement(spark):
    x = _two_d_blobs()
    df = _df(spark, x)
    m = DensityModel(min_cluster_size=10, min_samples=5).fit(df)
    far = spark.createDataFrame([(0, [1000.0, 1000.0]), (1, [5000.0, -5000.0])], "row_index long, features array<double>")
    sc = m.score(far).toPandas()
    assert (sc.novelty >= 0.5).all()
    assert (sc.cluster_id == -1).all() and (sc.novelty == 1.0).all()
    own = m.score(df).toPandas().sort_values("row_index")
    lab = m.labels.toPandas().sort_values("row_index")
    agree = (own.cluster_id.to_numpy() == lab.cluster_id.to_numpy()).mean()
    assert agree > 0.9
    assert own.strength.between(0, 1).all()
    nonnoise = own.cluster_id.to_numpy() >= 0
    assert np.corrcoef(own.novelty.to_numpy()[nonnoise], lab.outlier_score.to_numpy()[nonnoise])[0, 1] > 0.7


def _points(kind):
    rng = np.random.default_rng(5)
    if kind == "blobs":
        return np.vstack([rng.normal(m, s, (60, 3)) for m, s in ((0, 1), (5, 0.4), (-6, 2))] + [rng.uniform(-9, 9, (40, 3))])
    if kind == "repeats":
        x = rng.integers(0, 4, (80, 2)).astype(float)
        return np.vstack([x, x[:30], rng.normal(20, 1, (30, 2))])
    return rng.normal(0, 1, (150, 4))


def _table(labels):
    got = {r["row_index"]: (r["cluster_id"], r["probability"], r["outlier_score"]) for r in labels.collect()}
    return tuple(np.array([got[i][c] for i in range(len(got))]) for c in range(3))


@pytest.mark.parametrize("kind,mcs,ms,method", [("blobs", 10, 5, "eom"), ("blobs", 5, 3, "leaf"), ("noise", 5, 3, "eom"), ("noise", 8, 1, "eom")])
def test_fit_equals_the_dense_hierarchy(spark, kind, mcs, ms, method):
    x = _points(kind)
    m = DensityModel(min_cluster_size=mcs, min_samples=ms, cluster_selection_method=method).fit(_df(spark, x).repartition(3))
    cluster, prob, glosh = _table(m.labels)
    own, own_prob, own_glosh = dense.fit(x, mcs, ms, method)
    assert (cluster == own).all() and m.n_clusters == own.max() + 1
    assert np.allclose(prob, own_prob) and np.allclose(glosh, np.clip(own_glosh, 0, 1))


def test_tree_and_labels_dont_depend_on_lists_blocks_or_runs(spark):
    """Short lists force wider searches; repeated points and a grid give many equal weights."""
    for kind in ("blobs", "repeats"):
        x = _points(kind)
        rows = _df(spark, x).selectExpr("0L AS grp", "row_index AS id", "features AS vec")
        expected = dense.kruskal(dense.mutual_reachability(x, 3)[0])
        results = []
        for listed, kw, run in ((12, {}, 10**6), (3, {"broadcast_bytes": 0, "block_rows": 50}, 17)):
            pts, edges = with_core(rows, 3, listed, **kw)
            tree = spanning_tree(pts, edges, **kw)
            assert sorted(map(tuple, tree.select("lo", "hi", "w").collect())) == sorted((int(a), int(b), w) for a, b, w in expected)
            items, nodes = condense(tree, rows, 6, run=run)
            lam = {r["id"]: r["lam"] for r in items.collect()}
            results.append((lam, sorted((r["size"], r["birth"], r["direct"], r["flag"]) for r in nodes.collect())))
        assert results[0] == results[1] and len(results[0][0]) == len(x)


def test_many_fits_at_once_equal_single_fits(spark):
    fits = {1: _points("blobs"), 2: _points("noise")[:70], 3: _points("blobs")[:9], 4: _points("blobs")[:1]}
    rows = spark.createDataFrame([(g, i, [float(a) for a in v]) for g, x in fits.items() for i, v in enumerate(x)], "grp long, id long, vec array<double>")
    items, nodes = fit_groups(rows, 6, 3)
    got = {(r["grp"], r["id"]): r["cluster_id"] for r in items.collect()}
    assert len(got) == sum(map(len, fits.values()))
    for g in (1, 2, 3):
        assert [got[g, i] for i in range(len(fits[g]))] == dense.fit(fits[g], 6, 3)[0].tolist()
    assert got[4, 0] == -1
    new = spark.createDataFrame([(g, i, [float(i), 0.0, 1.0] + [0.5] * (g == 2)) for g in (1, 2, 3) for i in range(8)], "grp long, row_index long, features array<double>")
    broadcast = score_groups(new, items, nodes, 3).select("grp", "row_index", "cluster_id", "strength", "novelty").collect()
    joined = score_groups(new, items, nodes, 3, broadcast_bytes=0).select("grp", "row_index", "cluster_id", "strength", "novelty").collect()
    assert sorted((*r[:3], round(r[3], 9), round(r[4], 9)) for r in broadcast) == sorted((*r[:3], round(r[3], 9), round(r[4], 9)) for r in joined)


def test_single_cluster_and_wrong_settings(spark):
    x = _points("noise")
    m = DensityModel(min_cluster_size=60, min_samples=3, allow_single_cluster=True).fit(_df(spark, x))
    assert (_table(m.labels)[0] == dense.fit(x, 60, 3, allow_single_cluster=True)[0]).all()
    with pytest.raises(ValueError):
        DensityModel(cluster_selection_method="other").fit(_df(spark, x))
    with pytest.raises(ValueError):
        DensityModel().fit(_df(spark, x).limit(0))


def test_links_shrink_and_repeated_rows_dont_multiply(spark, monkeypatch):
    from quorum.operators import spanning

    sizes, stored = {}, spanning.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    x = _points("noise")
    once = _df(spark, x).selectExpr("0L AS grp", "row_index AS id", "features AS vec")
    rows = once.union(once)
    pts, edges = with_core(rows, 2, 3)
    monkeypatch.setattr(spanning, "stored", counted)
    tree = spanning_tree(pts, edges)
    assert tree.count() == len(x) - 1
    of = lambda kind: [n for name, n in sizes.items() if name.rsplit("-", 1)[0] == kind]
    assert of("asking") and max(of("asking")) <= 2 * len(x) and set(of("components")) == {2 * len(x)}
    links = of("links")
    assert links == sorted(set(links), reverse=True) and links[-1] == 0
