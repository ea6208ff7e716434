"""Evaluation aggregates (E9-E17): ARI, accuracy, silhouette, Davies-Bouldin, noise.

All of them are grouped aggregations; only fixed-size summaries reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.operators.knn import _mat, arrow_mat, dealt
from quorum.operators.nearest import ClusterSums, cheapest_partner, distances, row_bytes
from quorum.session import stored

DEFAULT_MAX_BROADCAST_POINTS = 100_000


def _c2(c):
    return c.cast("double") * (c.cast("double") - 1) / 2.0


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two partitions (rows with a NULL on either side dropped).

    Contingency counts come from one grouped count; row/column marginals and the
    pair sums are further grouped aggregates.  Both partitions trivial and equal
    (e.g. everything in one group) gives 1.0.
    """
    src = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    cont = src.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n"))
    tagged = (cont.select(F.lit("c").alias("t"), "n")
              .unionByName(cont.groupBy("__a").agg(F.sum("n").alias("n")).select(F.lit("a").alias("t"), "n"))
              .unionByName(cont.groupBy("__b").agg(F.sum("n").alias("n")).select(F.lit("b").alias("t"), "n")))
    j = tagged.agg(
        F.sum(F.when(F.col("t") == "c", _c2(F.col("n")))).alias("sc"),
        F.sum(F.when(F.col("t") == "c", F.col("n"))).alias("n"),
        F.sum(F.when(F.col("t") == "a", _c2(F.col("n")))).alias("sa"),
        F.sum(F.when(F.col("t") == "b", _c2(F.col("n")))).alias("sb"),
    )
    total = _c2(F.col("n"))
    expected = F.when(total > 0, F.col("sa") * F.col("sb") / total).otherwise(0.0)  # one row: no pairs
    mx = (F.col("sa") + F.col("sb")) / 2.0
    val = (F.when(F.col("n").isNull() | (F.col("n") == 0), F.lit(None).cast("double"))
           .when((mx - expected) == 0, F.lit(1.0))
           .otherwise((F.col("sc") - expected) / (mx - expected)))
    return j.select(val.alias("ari"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_pairs_rows"))


def ari_value(df: DataFrame, a: str, b: str) -> float | None:
    r = ari(df, a, b).head()
    return None if r is None else r["ari"]


def labeled_ari(df: DataFrame, pred: str = "cluster_id", label: str = "label") -> float | None:
    """ARI over labelled rows only; NULL when nothing is labelled."""
    return ari_value(df, pred, label)


def accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Accuracy over labelled rows plus the majority-class baseline."""
    lab = df.where(F.col(label).isNotNull())
    per = lab.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col(pred) == F.col(label)).alias("hit"))
    return per.agg((F.sum("hit") / F.sum("cnt")).alias("accuracy"), (F.max("cnt") / F.sum("cnt")).alias("majority_accuracy"),
                   F.sum("cnt").alias("n"))


def noise_summary(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Noise fraction, number of clusters without noise, number of points."""
    return df.agg(
        F.coalesce(F.avg((F.col(cluster) == -1).cast("double")), F.lit(0.0)).alias("noise_fraction"),
        F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("n_clusters"),
        F.count(F.lit(1)).alias("n_points"),
    )


#: vectors of this many bytes are broadcast at a time
PASS_BYTES = 64 << 20


def _runs(sizes: list[tuple[int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """Clusters (id, rows) dealt to runs of at most ``most`` rows: each a list of (id, part, parts), a part of a cluster only by itself."""
    out, room = [], 0
    for c, n in sizes:
        if n > most:
            parts = math.ceil(n / most)
            out += [[(c, p, parts)] for p in range(parts)]
            room = 0
        elif n <= room:
            out[-1].append((c, 0, 1))
            room -= n
        else:
            out.append([(c, 0, 1)])
            room = most - n
    return out


def _sums_to(refs: DataFrame, sizes: dict[int, int], split: bool):
    """Of each batch of (uid, cl, v) what a run of reference rows (cl, v) says: the sum of distances to the own cluster's
    rows in it, the least mean distance to another cluster and, if it holds a part of a cluster, the sum of distances to that."""
    table = refs.toArrow()
    ids, at = np.unique(table.column("cl").to_numpy(), return_inverse=True)
    shared = refs.sparkSession.sparkContext.broadcast((arrow_mat(table.column("v")), ids, at, np.array([sizes[int(c)] for c in ids], float)))

    def run(batches):
        x, ids, at, n = shared.value
        sums = ClusterSums(x, [(at, len(ids))])
        for p in batches:
            if len(p) == 0:
                continue
            cl = p["cl"].to_numpy(np.int64)
            total, = sums.of(_mat(p["v"]))
            mine = np.minimum(np.searchsorted(ids, cl), len(ids) - 1)
            is_own = ids[mine] == cl
            rows = np.arange(len(p))
            own = np.where(is_own, total[rows, mine], 0.0)
            out = p.drop(columns="v").assign(own=own)
            if split:
                yield out.assign(best=np.inf, part=np.where(is_own, np.inf, total[:, 0]))
                continue
            other = total / n
            other[rows[is_own], mine[is_own]] = np.inf
            yield out.assign(best=other.min(axis=1), part=np.inf)

    return run, shared


def _silhouette_rows_broadcast(pts: DataFrame, vec: str, cluster: str) -> DataFrame:
    """All rows in one run: each task has what it needs for its rows' values."""
    pdf = pts.select("row_index", cluster, vec).toPandas()
    names, at = np.unique(pdf[cluster].to_numpy(), return_inverse=True)
    shared = pts.sparkSession.sparkContext.broadcast((_mat(pdf[vec]), names, at, np.bincount(at, minlength=len(names)).astype(float)))

    def run(batches):
        x, names, at, n = shared.value
        sums = ClusterSums(x, [(at, len(names))]) if len(x) else None
        for p in batches:
            if len(p) == 0:
                continue
            total, = sums.of(_mat(p[vec]))
            of = np.searchsorted(names, p[cluster].to_numpy())
            mine = np.arange(len(p)), of
            inner = np.where(n[of] > 1, total[mine] / np.maximum(n[of] - 1, 1), 0.0)
            other = total / n
            other[mine] = np.inf
            outer = other.min(axis=1)
            top = np.maximum(inner, outer)
            s = np.where((n[of] > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1.0), 0.0)
            yield pd.DataFrame({"row_index": p["row_index"].to_numpy(np.int64), "s": s})

    return pts.select("row_index", cluster, vec).mapInPandas(run, "row_index long, s double")


def silhouette_rows(df: DataFrame, vec: str = "features", cluster: str = "cluster_id", *,
                    max_broadcast_points: int = DEFAULT_MAX_BROADCAST_POINTS, block_rows: int = 2048,
                    strategy: str | None = None) -> DataFrame:
    """E11 per row on non-noise rows (Euclidean, Rousseeuw): (row_index, s); singletons 0.

    Quadratic by definition. The rows are broadcast, in runs of whole clusters if they pass ``max_broadcast_points`` or
    ``PASS_BYTES`` (``strategy`` "blocked": runs of ``block_rows``), and every row meets every run once.  A run leaves
    one record for each row, however many clusters there are; never pairs.
    """
    pts = df.where(F.col(cluster) != -1).select("row_index", F.col(cluster).cast("long").alias("cl"), F.col(vec).alias("v"))
    found = pts.groupBy("cl").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).orderBy("cl").collect()
    sizes = {r["cl"]: r["n"] for r in found}  # one row per cluster
    width = max((r["w"] or 0 for r in found), default=0)
    most = {"blocked": block_rows, "broadcast": max(sum(sizes.values()), 1)}.get(
        strategy, max(1, min(max_broadcast_points, PASS_BYTES // row_bytes(width))))
    runs = _runs([*sizes.items()], most)
    spark = df.sparkSession
    place = [(c, p, parts, i, sizes[c], parts > 1) for i, run in enumerate(runs) for c, p, parts in run]
    where = spark.createDataFrame(place, "cl long, p long, parts long, run int, n_own long, split boolean")
    fields = "row_index long, cl long, n_own long, own double, best double, part double"
    if len(runs) <= 1:
        return _silhouette_rows_broadcast(dealt(pts, sum(sizes.values())), "v", "cl")
    pts = pts.withColumn("uid", F.monotonically_increasing_id())  # row_index may repeat
    mine = F.broadcast(where.select(F.col("cl").alias("c"), "p", "parts", "run", "n_own"))
    pts = stored(pts.join(mine, (F.col("cl") == F.col("c")) & (F.pmod(F.xxhash64("uid"), F.col("parts")) == F.col("p"))).select(
        "uid", "row_index", "cl", "n_own", "run", "v"), "points")
    parts = []
    for i, members in enumerate(runs):
        split = members[0][2] > 1
        run, shared = _sums_to(pts.where(F.col("run") == i).select("cl", "v"), sizes, split)
        out = dealt(pts.select("uid", "row_index", "cl", "n_own", "v"), most).mapInPandas(run, "uid long, " + fields)
        of = members[0][0] if split else None
        parts.append(stored(out.withColumn("of", F.lit(of).cast("long")).withColumn("n_of", F.lit(sizes.get(of)).cast("long")), f"run-{i}"))
        shared.destroy()
    nan = lambda c: F.when(F.bool_or(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c))
    by_part = reduce(DataFrame.unionByName, parts).groupBy("uid", "row_index", "n_own", "of", "n_of").agg(
        F.sum("own").alias("own"), nan("best").alias("best"), F.sum("part").alias("part"))
    by_part = by_part.withColumn("best", F.when(F.col("of").isNull(), F.col("best")).otherwise(F.col("part") / F.col("n_of")))
    whole = by_part.groupBy("uid", "row_index", "n_own").agg(F.sum("own").alias("own"), nan("best").alias("best"))
    return whole.select("row_index", _silhouette_of("best").alias("s"))


def _silhouette_of(b: str):
    """Of the columns n_own and own; 0 for the only row of a cluster and where nothing is apart."""
    a = F.col("own") / F.greatest(F.col("n_own") - 1, F.lit(1))
    top = F.greatest(a, F.col(b))
    return F.when((F.col("n_own") > 1) & ~F.isnan(top) & (top > 0), (F.col(b) - a) / top).otherwise(0.0)


def silhouette(df: DataFrame, vec: str = "features", cluster: str = "cluster_id", **kw) -> float | None:
    """Mean silhouette; NULL with fewer than two clusters."""
    k = df.where(F.col(cluster) != -1).agg(F.count_distinct(cluster)).head()[0]
    if k is None or k < 2:
        return None
    return silhouette_rows(df, vec, cluster, **kw).agg(F.avg("s")).head()[0]


def silhouette_sq(df: DataFrame, vec: str = "features", cluster: str = "cluster_id") -> float | None:
    """Linear-time silhouette on squared Euclidean distances (Spark ML's evaluator definition)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    pts = df.where(F.col(cluster) != -1).select(array_to_vector(vec).alias("v"), F.col(cluster).cast("double").alias("c"))
    if pts.select("c").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(featuresCol="v", predictionCol="c", distanceMeasure="squaredEuclidean").evaluate(pts)


def _similarity(qv: np.ndarray, qx: np.ndarray, rv: np.ndarray, rx: np.ndarray) -> np.ndarray:
    """Less the sum of both scatters over the distance of the centroids; 0 where those coincide."""
    d = distances(qv, rv)
    return -np.where(d > 0, (qx + rx[:, 0][None, :]) / np.where(d > 0, d, 1.0), 0.0)


def davies_bouldin_groups(rows: DataFrame, **kw) -> DataFrame:
    """E12 of each group of (grp, cluster, vec), noise left out before: (grp, davies_bouldin).

    Centroids and scatters are grouped aggregates; each cluster's worst partner is a join in blocks
    of centroids, so the number of clusters isn't bounded.  0 if no cluster scatters.
    """
    from quorum.functions.vectors import euclidean

    means = rows.select("grp", "cluster", F.posexplode("vec").alias("i", "x")).groupBy("grp", "cluster", "i").agg(F.avg("x").alias("x"))
    centres = means.groupBy("grp", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    centres = stored(centres, "centres")
    scatter = rows.join(centres, ["grp", "cluster"]).groupBy("grp", "cluster").agg(F.avg(euclidean(F.col("vec"), F.col("centre"))).alias("s"))
    table = stored(centres.join(scatter, ["grp", "cluster"]).select("grp", F.col("cluster").alias("id"), F.col("centre").alias("vec"), F.array("s").alias("x")), "scatters")
    worst = cheapest_partner(table, _similarity, **kw).groupBy("grp").agg(F.avg(-F.col("cost")).alias("davies_bouldin"))
    still = table.groupBy("grp").agg(F.max(F.col("x")[0]).alias("most"))
    return worst.join(still, "grp").select("grp", F.when(F.col("most") <= 1e-8, 0.0).otherwise(F.col("davies_bouldin")).alias("davies_bouldin"))


def davies_bouldin(df: DataFrame, vec: str = "features", cluster: str = "cluster_id", **kw) -> float | None:
    """E12 on non-noise rows; NULL with fewer than two clusters."""
    pts = df.where(F.col(cluster) != -1)
    if pts.select(cluster).distinct().limit(2).count() < 2:
        return None
    rows = pts.select(F.lit(0).cast("long").alias("grp"), F.col(cluster).cast("long").alias("cluster"), F.col(vec).alias("vec"))
    return davies_bouldin_groups(rows, **kw).head()["davies_bouldin"]


def internal_metrics(df: DataFrame, vec: str = "features", cluster: str = "cluster_id") -> DataFrame:
    """T10 row: silhouette, davies_bouldin, noise_fraction, n_clusters, n_points (NULL metrics when < 2 clusters)."""
    ns = noise_summary(df, cluster).head()
    sil = db = None
    if ns["n_clusters"] >= 2:
        sil = silhouette(df, vec, cluster)
        db = davies_bouldin(df, vec, cluster)
    return df.sparkSession.createDataFrame(
        [(sil, db, float(ns["noise_fraction"]), int(ns["n_clusters"]), int(ns["n_points"]))],
        "silhouette double, davies_bouldin double, noise_fraction double, n_clusters long, n_points long",
    )


def cluster_purity(df: DataFrame, cluster: str = "cluster_id", label: str = "label") -> DataFrame:
    """Per cluster with labels (noise included), largest class count / labelled count."""
    lab = df.where(F.col(label).isNotNull())
    per = lab.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(cluster).agg((F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("n_labeled"))


def summary_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, population std, min, max and count of a score column (NaN skipped)."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                  F.count(v).alias("n"))


def class_distribution(df: DataFrame, col: str = "predicted") -> DataFrame:
    """Rows per propagated class plus the number of distinct classes."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    k = counts.count()  # one row per class: bounded by the number of classes
    return counts.withColumn("n_classes", F.lit(k))
