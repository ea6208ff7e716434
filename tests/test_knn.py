import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorum.operators import knn as knn_module
from quorum.operators import metrics, pairdist
from quorum.operators.knn import _exact_dist, knn, radius_neighbors, topk_block, within_block
from quorum.operators.nearest import k_nearest
from quorum.sources import stand_ins as si

from conftest import SF_SMALL


def _brute(x, ids, q, qids, k, exclude_self):
    out = {}
    for i, qq in enumerate(q):
        d = np.sqrt(((x - qq) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        res = [(int(ids[j]), float(d[j])) for j in order if not (exclude_self and ids[j] == qids[i])][:k]
        out[int(qids[i])] = res
    return out


@pytest.mark.parametrize("strategy", ["broadcast", "pivot"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_matches_brute_force(spark, strategy, exclude_self):
    df = si.blobs(spark, SF_SMALL).withColumnRenamed("sensors", "features")
    pdf = df.toPandas()
    x = np.stack(pdf["features"].to_numpy())
    ids = pdf["row_index"].to_numpy()
    got = knn(df, df, 5, exclude_self=exclude_self, strategy=strategy, block_rows=37, n_pivots=9).toPandas()
    want = _brute(x, ids, x, ids, 5, exclude_self)
    assert len(got) == 5 * len(ids)
    for qid, g in got.groupby("row_index"):
        g = g.sort_values("rank")
        assert [int(v) for v in g["nbr_index"]] == [w[0] for w in want[qid]]
        assert np.allclose(g["distance"].to_numpy(), [w[1] for w in want[qid]])


@pytest.mark.parametrize("strategy", ["broadcast", "pivot"])
def test_radius_counts(spark, strategy):
    df = si.blobs(spark, SF_SMALL).withColumnRenamed("sensors", "features")
    pdf = df.toPandas()
    x = np.stack(pdf["features"].to_numpy())
    ids = pdf["row_index"].to_numpy()
    eps = 0.9
    got = radius_neighbors(df, df, eps, count_only=True, strategy=strategy, block_rows=50, n_pivots=7).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    want = dict(zip(ids, (d <= eps).sum(axis=1)))
    assert {int(r.row_index): int(r.n_within) for r in got.itertuples()} == {int(k): int(v) for k, v in want.items()}


@pytest.mark.parametrize("exclude_self", [False, True])
def test_block_keeps_ties_and_far_from_origin(exclude_self):
    rng = np.random.default_rng(5)
    equal = np.ones((40, 3))
    far = 1e6 + 1e-3 * rng.standard_normal((300, 4))
    mixed = np.vstack([equal[:, :3], rng.standard_normal((60, 3)) * 1e-9 + 1, np.full((1, 3), 1e5)])
    for x in (equal, far, mixed):
        ids = rng.permutation(len(x)) * 3
        for k in (1, 3, len(x) - 1, len(x) + 5):
            qi, ri, d = topk_block(x, ids, x, ids, k, exclude_self)
            want = _brute(x, ids, x, ids, k, exclude_self)
            got = {int(i): [] for i in ids}
            for q, r, e in zip(qi, ri, d):
                got[int(ids[q])].append((int(ids[r]), float(e)))
            assert got == want


def test_equal_points_give_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_index long, features array<double>").repartition(4)
    for strategy in ("broadcast", "pivot"):
        got = knn(df, df, 3, strategy=strategy, block_rows=7, n_pivots=3).where("row_index = 11").orderBy("rank").collect()
        assert [r.nbr_index for r in got] == [0, 1, 2]


class Local:
    """Stands for a table and its session: gives a fixed frame and the mapper itself."""

    def __init__(self, frame):
        self.frame = frame
        self.sparkSession = self.sparkContext = self

    def select(self, *columns):
        return self

    def toPandas(self):
        return self.frame

    def broadcast(self, value):
        return type("Shared", (), {"value": value})

    def mapInPandas(self, run, schema):
        return run


def peak(run):
    """(MB that ``run`` held at most beyond what there was, its result)."""
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1] / 2**20, out
    finally:
        tracemalloc.stop()


def wide(n):
    rng = np.random.default_rng(1)
    return pd.DataFrame({"row_index": np.arange(n), "cluster_id": rng.integers(0, 3, n), "features": list(rng.normal(size=(n, 64)))})


def test_silhouette_holds_a_bounded_block():
    frame = wide(3000)
    x, lab = np.stack(frame["features"]), frame["cluster_id"].to_numpy()
    run = metrics._silhouette_rows_broadcast(Local(frame), "features", "cluster_id")
    used, out = peak(lambda: pd.concat(run(iter([frame.iloc[:300]]))))
    d = np.sqrt(((x[:300, None, :] - x[None, :, :]) ** 2).sum(-1))
    means = np.stack([d[:, lab == c].sum(axis=1) / ((lab == c).sum() - (lab[:300] == c)) for c in range(3)], 1)
    a = means[np.arange(300), lab[:300]]
    means[np.arange(300), lab[:300]] = np.inf
    assert np.allclose(out["s"], (means.min(axis=1) - a) / np.maximum(a, means.min(axis=1)))
    assert used < 150


def test_pair_distances_hold_a_bounded_block():
    frame = wide(3000).rename(columns={"cluster_id": "c", "features": "v"})
    used, n = peak(lambda: sum(len(d) for _, _, d in pairdist._pairs_block(frame.iloc[:300], frame)))
    assert n == 300 * 2999 and used < 150


def test_top_k_holds_one_matrix_and_a_copy():
    rng = np.random.default_rng(2)
    rv, ids = rng.normal(size=(20_000, 8)), np.arange(20_000)
    used, (qi, ri, d) = peak(lambda: topk_block(rv[:300], ids[:300], rv, ids, 3, True))
    assert used < 60 and len(qi) == 900
    for i in (0, 7, 299):
        own = np.sqrt(((rv - rv[i]) ** 2).sum(axis=1))
        own[i] = np.inf
        assert ri[qi == i].tolist() == np.argsort(own)[:3].tolist() and np.allclose(d[qi == i], np.sort(own)[:3])


@pytest.mark.parametrize("bound", [20_000, 10])
def test_pair_quantiles_equal_all_pairs(spark, bound, monkeypatch):
    monkeypatch.setattr(pairdist, "_PAIR_BYTES", 400)
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(40, 3)), rng.integers(1, 3, 40)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(c[i])) for i in range(40)], "row_index long, features array<double>, label double")
    got = pairdist.pair_distance_quantiles(df, (0.25, 0.5), max_broadcast_rows=bound, block_rows=9).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(got) == 8
    for r in got:
        i, j = np.nonzero((c[:, None] == r["class"]) & ((c[:, None] == c[None]) == r["same"]) & ~np.eye(40, dtype=bool))
        assert r["n_pairs"] == len(i) and abs(r["distance"] - np.quantile(d[i, j], r["prob"])) < 1e-9


def test_counts_and_pairs_within_a_radius_are_bounded_and_exact():
    rng = np.random.default_rng(8)
    far = 1e6 + 1e-3 * rng.standard_normal((300, 4))
    mixed = np.vstack([np.ones((40, 4)), 1 + 1e-9 * rng.standard_normal((60, 4)), np.full((1, 4), 1e5), [[np.nan, 1, 1, 1]], [[np.inf, 1, 1, 1]]])
    huge = np.vstack([np.full((5, 4), 1e200), np.full((5, 4), -1e200), np.zeros((5, 4))])
    grid = np.stack(np.meshgrid(*[np.arange(6.0)] * 3), -1).reshape(-1, 3) / 10
    for x, radii in ((far, (0.0, 2e-3, 5.0)), (mixed, (0.0, 1e-9, 1.0, 1e9, np.inf)), (huge, (0.0, 1.0)), (grid, (0.1, 0.2, np.sqrt(0.02), -1.0))):
        with np.errstate(all="ignore"):
            d = np.sqrt(np.einsum("ijk,ijk->ij", x[:, None] - x[None], x[:, None] - x[None]))
            for eps in radii:
                assert within_block(x, x, eps, True).tolist() == (d <= eps).sum(axis=1).tolist()
                qi, ri, dist = within_block(x, x, eps)
                assert sorted(zip(qi, ri)) == list(zip(*np.nonzero(d <= eps))) and np.array_equal(dist, d[qi, ri])
    wide_rows = rng.normal(size=(20_000, 64))
    start = time.process_time()
    used, n = peak(lambda: within_block(wide_rows[:1000], wide_rows, 9.0, True))
    spent = time.process_time() - start
    start = time.process_time()
    assert n[:100].tolist() == (_exact_dist(wide_rows[:100], wide_rows) <= 9.0).sum(axis=1).tolist()
    assert used < 60 and spent < 5 * (time.process_time() - start)


def test_many_equal_distances_are_kept_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(knn_module, "_KEPT", 1000)
    rng = np.random.default_rng(3)
    x = rng.permutation(np.repeat(rng.normal(size=(4, 5)), 2500, axis=0))
    ids = rng.permutation(len(x))
    used, (qi, ri, d) = peak(lambda: topk_block(x[:200], ids[:200], x, ids, 3, True))
    assert used < 60 and len(qi) == 600 and not d.any()
    for i in range(0, 200, 40):
        same = np.sort(ids[(x == x[i]).all(axis=1) & (ids != ids[i])])
        assert ids[ri[qi == i]].tolist() == same[:3].tolist()


def test_rows_of_one_part_are_dealt_to_many_tasks(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"row_index": np.arange(3000), "features": list(rng.normal(size=(3000, 2)))})
    df = spark.createDataFrame(pdf).coalesce(1)
    for out in (radius_neighbors(df, df, 0.3, count_only=True), knn(df, df, 2),
                k_nearest(df.selectExpr("0L AS grp", "row_index AS id", "features AS vec"), 2)):
        assert out.select(F.spark_partition_id()).distinct().count() > 4


def test_blocks_where_pivots_prune_nothing(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 16))
    df = spark.createDataFrame(pd.DataFrame({"row_index": np.arange(200), "features": list(x)}))
    want = _brute(x, np.arange(200), x, np.arange(200), 3, True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for strategy in ("groups", "blocks"):
        got = knn(df, df, 3, exclude_self=True, strategy=strategy, block_rows=30, n_pivots=9).orderBy("row_index", "rank").toPandas()
        assert got["nbr_index"].tolist() == [w[0] for i in range(200) for w in want[i]]
        n = radius_neighbors(df, df, 4.0, count_only=True, strategy=strategy, block_rows=30, n_pivots=9).orderBy("row_index").toPandas()
        assert n["n_within"].tolist() == (d <= 4.0).sum(axis=1).tolist()
    q, _ = knn_module._meeting(*[df.selectExpr(f"row_index AS {a}id", f"features AS {a}vec") for a in ("__q", "__r")], 50, 4, "groups", 4, None)
    assert q.count() == 200 and q.select("cell").distinct().count() == 1
