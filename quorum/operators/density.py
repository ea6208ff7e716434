"""Density clustering (HDBSCAN*) as Spark jobs (I1-I11), one fit or many at once.

Fit: exact k-NN lists give core distances; ``spanning`` joins components by their lightest edges of
mutual reachability; ``condensing`` makes the condensed tree from the sorted tree edges; selection,
labels, membership and outlier scores are joins on the table of condensed clusters.  There is one
path for every size: nothing passes through one group or the driver.

Cluster ids are numbered 0..k-1 by their smallest row, so they don't depend on partitioning.

Scoring new rows (I9-I11) finds the training row of the smallest mutual reachability among the
2 x min_samples nearest, climbs to the first condensed cluster born no later than the row's lambda,
and takes the selected cluster above it.  A model within a checked size is broadcast and one pass
over the rows scores them; beyond it the same steps are joins.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.operators.condensing import condense, select
from quorum.operators.knn import _mat, knn, topk_block
from quorum.operators.nearest import gathered, row_bytes
from quorum.operators.spanning import spanning_tree, with_core
from quorum.session import stored

#: a model is broadcast up to so many bytes
BROADCAST_BYTES = 256 << 20
METHODS = ("eom", "leaf")


def core_distances(pts: DataFrame, min_samples: int, vec: str = "features", **kw) -> DataFrame:
    """Distance to the min_samples-th other row: (row_index, core_distance)."""
    nb = knn(pts, pts, min_samples, qvec=vec, rvec=vec, exclude_self=True, **kw)
    return nb.groupBy("row_index").agg(F.max_by("distance", "rank").alias("core_distance"))


def mutual_reachability_edges(pts: DataFrame, min_samples: int, vec: str = "features", **kw) -> DataFrame:
    """I2 over the kNN graph: (row_index, nbr_index, distance, mreach)."""
    nb = knn(pts, pts, min_samples, qvec=vec, rvec=vec, exclude_self=True, **kw)
    core = nb.groupBy("row_index").agg(F.max_by("distance", "rank").alias("core_distance"))
    e = nb.join(core, "row_index").join(core.select(F.col("row_index").alias("nbr_index"), F.col("core_distance").alias("nbr_core")),
                                        "nbr_index")
    return e.select("row_index", "nbr_index", "distance",
                    F.greatest("distance", "core_distance", "nbr_core").alias("mreach"))


def fit_groups(rows: DataFrame, min_cluster_size: int | dict[int, int], min_samples: int | dict[int, int], method: str = "eom", *,
               allow_single_cluster: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fit every group of rows (grp, id, vec) by itself, in the same jobs, with settings of its own if they are maps:

    items (grp, id, vec, core, node, lam, cluster_id, prob, glosh), one per row, and
    nodes (grp, node, parent, birth, direct, below, root, top, cluster_id), one per condensed cluster;
    a node's ``cluster_id`` is that of ``top``, -1 if nothing above it is selected.
    """
    if method not in METHODS:
        raise ValueError(f"unknown selection method {method!r}, known are {METHODS}")
    rows = stored(rows.select("grp", "id", "vec"), "rows")
    pts, edges = with_core(rows, min_samples)
    return _clusters(pts, spanning_tree(pts, edges), min_cluster_size, method, allow_single_cluster)


def fit_grid(df: DataFrame, min_cluster_sizes: Sequence[int], min_samples: Sequence[int], vec: str = "features") -> DataFrame:
    """(min_cluster_size, min_samples, row_index, cluster_id, probability, outlier_score) of every setting (H6).

    One spanning tree for each min_samples, condensed for each min_cluster_size.
    """
    wide = len(min_cluster_sizes)
    several = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = df.select(F.col("row_index").cast("long").alias("id"), F.col(vec).alias("vec")).withColumn("grp", several(len(min_samples)))
    rows = stored(rows.select("grp", "id", "vec"), "rows")
    pts, edges = with_core(rows, dict(enumerate(min_samples)))
    tree = spanning_tree(pts, edges)
    spread = lambda t: t.withColumn("j", several(wide)).withColumn("grp", F.col("grp") * wide + F.col("j")).drop("j")
    settings = [(i * wide + j, m, s) for i, s in enumerate(min_samples) for j, m in enumerate(min_cluster_sizes)]
    items, _ = _clusters(stored(spread(pts), "grid"), spread(tree), {g: m for g, m, _ in settings})
    names = df.sparkSession.createDataFrame(settings, "grp long, min_cluster_size int, min_samples int")
    return labels_of(items).join(F.broadcast(names), "grp").drop("grp")


def _clusters(pts: DataFrame, tree: DataFrame, min_cluster_size, method: str = "eom", allow_single_cluster: bool = False) -> tuple[DataFrame, DataFrame]:
    falls, nodes = condense(tree, pts.select("grp", "id"), min_cluster_size, method=method)
    nodes = stored(select(nodes, allow_single_cluster=allow_single_cluster), "nodes")
    placed = falls.join(nodes.select("grp", "node", "top", "below"), ["grp", "node"])
    # one row per selected cluster in the window
    least = placed.where("top IS NOT NULL").groupBy("grp", "top").agg(F.min("id").alias("least"))
    ids = least.select("grp", "top", (F.row_number().over(Window.partitionBy("grp").orderBy("least")) - 1).alias("cluster_id"))
    tops = nodes.select("grp", F.col("node").alias("top"), F.col("direct").alias("top_direct"))
    inf = float("inf")
    lam, direct, below = F.col("lam"), F.col("top_direct"), F.col("below")
    inside = F.when((direct == 0) | (lam == inf), 1.0).otherwise(F.least(lam, direct) / direct)
    outlying = F.when((below == 0) | (lam == inf) | (below == inf), 0.0).otherwise((below - lam) / below)
    items = placed.join(ids, ["grp", "top"], "left").join(tops, ["grp", "top"], "left").join(pts.drop("bound"), ["grp", "id"])
    items = items.select("grp", "id", "vec", "core", "node", "lam", F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"),
                         F.when(F.col("top").isNull(), 0.0).otherwise(inside).alias("prob"), outlying.alias("glosh"))
    nodes = nodes.join(ids, ["grp", "top"], "left").select(
        "grp", "node", "parent", "birth", "direct", "below", "root", "top", F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"))
    return stored(items, "items"), stored(nodes, "clusters")


def labels_of(items: DataFrame) -> DataFrame:
    """(grp, row_index, cluster_id, probability, outlier_score) of the training rows."""
    return items.select("grp", F.col("id").alias("row_index"), "cluster_id", F.col("prob").alias("probability"),
                        F.least(F.lit(1.0), F.greatest(F.lit(0.0), "glosh")).alias("outlier_score"))


@dataclass
class DensityModel:
    """One fitted table: a clusterer of the kind that ``plans.train`` takes (fit, labels, score, n_clusters)."""

    min_cluster_size: int = 10
    min_samples: int = 5
    cluster_selection_method: str = "eom"
    allow_single_cluster: bool = False
    items: DataFrame | None = None
    nodes: DataFrame | None = None
    _shared: object = field(default=None, repr=False, compare=False)

    def fit(self, df: DataFrame, vec: str = "features") -> DensityModel:
        rows = df.select(F.lit(0).cast("long").alias("grp"), F.col("row_index").cast("long").alias("id"), F.col(vec).alias("vec"))
        if rows.isEmpty():
            raise ValueError("cannot fit on an empty table")
        self.items, self.nodes = fit_groups(rows, self.min_cluster_size, self.min_samples, self.cluster_selection_method,
                                            allow_single_cluster=self.allow_single_cluster)
        return self

    @property
    def labels(self) -> DataFrame:
        """(row_index, cluster_id, probability, outlier_score) of the training rows."""
        return labels_of(self.items).drop("grp")

    @property
    def n_clusters(self) -> int:
        return self.nodes.where("cluster_id >= 0").select("cluster_id").distinct().count()

    def score(self, df: DataFrame, vec: str = "features", **kw) -> DataFrame:
        """The input's columns, cluster_id, strength, novelty; noise has novelty 1."""
        grouped = df.withColumn("grp", F.lit(0).cast("long"))
        if self._shared is None:  # made once and used by every later call
            self._shared = shared_states(self.items, self.nodes, self.min_samples, **kw)
        return score_groups(grouped, self.items, self.nodes, self.min_samples, vec, shared=self._shared).drop("grp")


# ------------------------------------------------------------------ scoring

#: stands for a model that is too large to broadcast
TOO_LARGE = "too large"


def shared_states(items: DataFrame, nodes: DataFrame, min_samples: int, broadcast_bytes: int = BROADCAST_BYTES):
    """The models of all groups as a broadcast, or ``TOO_LARGE``."""
    found = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w")).head()
    if found["n"] * row_bytes(6 + (found["w"] or 0)) > broadcast_bytes:
        return TOO_LARGE
    return items.sparkSession.sparkContext.broadcast(_states(items, nodes, min_samples))


def score_groups(df: DataFrame, items: DataFrame, nodes: DataFrame, min_samples: int, vec: str = "features", *,
                 broadcast_bytes: int = BROADCAST_BYTES, shared=None) -> DataFrame:
    """``df`` (grp, row_index, vec, ...) with cluster_id, strength and novelty by the model of its group."""
    shared = shared_states(items, nodes, min_samples, broadcast_bytes) if shared is None else shared
    if shared == TOO_LARGE:
        return _score_joined(df, items, nodes, min_samples, vec)
    return _score_broadcast(df, shared, vec)


def _states(items: DataFrame, nodes: DataFrame, min_samples: int) -> dict[int, dict]:
    by_node = {int(g): pdf.sort_values("node") for g, pdf in nodes.toPandas().groupby("grp")}
    states = {}
    for g, (ids, vec, other) in gathered(items.withColumn("x", F.array("core", F.col("node").cast("double"), "lam")), "vec", "x").items():
        own, (core, at_node, lam) = by_node[g], other.T
        node = own["node"].to_numpy(np.int64)
        place = lambda v, node=node: np.searchsorted(node, v)
        root = own["root"].to_numpy(bool)
        top = own["top"].fillna(-1).to_numpy(np.int64)
        states[int(g)] = {
            "vec": vec, "id": ids, "core": core.copy(), "lam": lam.copy(),
            "node": place(at_node.astype(np.int64)), "ms": max(1, min(min_samples, len(ids) - 1)), "root": root,
            "parent": np.where(root, np.arange(len(node)), place(own["parent"].to_numpy(np.int64))),
            "birth": own["birth"].to_numpy(float), "below": own["below"].to_numpy(float), "cluster": own["cluster_id"].to_numpy(np.int64),
            "direct": np.where(top >= 0, own["direct"].to_numpy(float)[np.minimum(place(top), len(node) - 1)], 0.0)}
    return states


def _score_broadcast(df: DataFrame, shared, vec: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("cluster_id", T.IntegerType()), T.StructField("strength", T.DoubleType()),
                           T.StructField("novelty", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for g, pdf in batch.groupby("grp"):
                cluster, strength, novelty = score_points(_mat(pdf[vec]), shared.value[int(g)])
                yield pdf.assign(cluster_id=cluster.astype("int32"), strength=strength, novelty=novelty)

    return df.mapInPandas(run, schema)


def _share(value, least) -> np.ndarray:
    """(value - least) / value where that is a number, else 0."""
    good = (value > 0) & np.isfinite(value)
    return np.where(good, (value - least) / np.where(good, value, 1.0), 0.0)


def score_points(x: np.ndarray, st: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, strength, novelty) of each row of x by the state of one model."""
    n, ms = len(st["vec"]), st["ms"]
    k = min(2 * ms, n)
    # no row of x is a training row here: equal points are neighbours like any others
    _, near, dist = topk_block(x, np.full(len(x), -1), st["vec"], st["id"], k, False)
    near, dist = near.reshape(len(x), k), dist.reshape(len(x), k)
    reach = np.maximum(np.maximum(st["core"][near], dist[:, min(ms, k - 1)][:, None]), dist)
    j = reach.argmin(axis=1)
    best = reach[np.arange(len(x)), j]
    lam = np.where(best > 0, 1.0 / np.where(best > 0, best, 1.0), np.finfo(float).max)
    item = near[np.arange(len(x)), j]
    node, climbs = st["node"][item], st["lam"][item] > lam
    while True:
        up = climbs & ~st["root"][node] & (st["birth"][node] >= lam)
        if not up.any():
            break
        node = np.where(up, st["parent"][node], node)
    cluster, direct = st["cluster"][node], st["direct"][node]
    inside = cluster >= 0
    good = inside & (direct > 0) & np.isfinite(direct)
    strength = np.where(good, np.minimum(lam, direct) / np.where(good, direct, 1.0), inside.astype(float))
    novelty = np.where(inside, _share(st["below"][node], lam), 1.0)
    return cluster, strength, np.clip(novelty, 0.0, 1.0)


def _score_joined(df: DataFrame, items: DataFrame, nodes: DataFrame, min_samples: int, vec: str) -> DataFrame:
    """As the broadcast way by joins: nearest training rows, then one join for each level climbed."""
    parts = []
    for g in [r["grp"] for r in items.select("grp").distinct().collect()]:  # groups are fits, a parameter
        own = items.where(F.col("grp") == g)
        n = own.count()
        ms = max(1, min(min_samples, n - 1))
        k = min(2 * ms, n)
        refs = own.select(F.col("id").alias("row_index"), "vec", "core", "node", "lam")
        mine = df.where(F.col("grp") == g).select("row_index", F.col(vec).alias("vec"))
        near = knn(mine, refs, k, qvec="vec", rvec="vec", payload=["core", "node", "lam"])
        lists = near.groupBy("row_index").agg(F.max(F.when(F.col("rank") == min(ms, k - 1) + 1, F.col("distance"))).alias("own"),
                                              F.collect_list(F.struct("rank", "distance", "core", "node", "lam")).alias("near"))
        reach = F.transform("near", lambda s: F.struct(F.greatest("own", s["core"], s["distance"]).alias("w"), s["rank"].alias("rank"),
                                                       s["node"].alias("node"), s["lam"].alias("lam")))
        parts.append(lists.select(F.lit(g).alias("grp"), "row_index", F.array_min(reach).alias("best")))
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    lam = F.when(F.col("best.w") > 0, 1 / F.col("best.w")).otherwise(F.lit(float(np.finfo(float).max)))
    at = best.select("grp", "row_index", F.col("best.node").alias("node"), lam.alias("lam"), (F.col("best.lam") > lam).alias("climbs"))
    ups = nodes.select("grp", "node", "parent", "birth", "root")
    level = 0
    while True:
        up = F.col("climbs") & ~F.col("root") & (F.col("birth") >= F.col("lam"))
        at = at.join(ups, ["grp", "node"]).select("grp", "row_index", "lam", F.when(up, F.col("parent")).otherwise(F.col("node")).alias("node"), up.alias("climbs"))
        at = stored(at, f"climb-{level}")
        level += 1
        if at.where("climbs").isEmpty():
            break
    tops = nodes.select("grp", F.col("node").alias("top"), F.col("direct").alias("top_direct"))
    ends = at.join(nodes.select("grp", "node", "below", "top", "cluster_id"), ["grp", "node"]).join(tops, ["grp", "top"], "left")
    inf = float("inf")
    inside, direct, below = F.col("cluster_id") >= 0, F.col("top_direct"), F.col("below")
    strength = F.when(~inside, 0.0).when((direct > 0) & (direct < inf), F.least("lam", direct) / direct).otherwise(1.0)
    novelty = F.when(~inside, 1.0).when((below > 0) & (below < inf), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (below - F.col("lam")) / below))).otherwise(0.0)
    scores = ends.select("grp", "row_index", "cluster_id", strength.alias("strength"), novelty.alias("novelty"))
    return df.join(scores, ["grp", "row_index"]).select(*df.columns, "cluster_id", "strength", "novelty")


# ------------------------------------------------------------------ tables of a model

_PARAMS = ("min_cluster_size", "min_samples", "cluster_selection_method", "allow_single_cluster")


def model_tables(model: DensityModel) -> dict[str, DataFrame]:
    spark = model.items.sparkSession
    params = json.dumps({k: getattr(model, k) for k in _PARAMS})
    return {"density_items": model.items, "density_nodes": model.nodes, "density_params": spark.createDataFrame([(params,)], "value string")}


def model_from_tables(items: DataFrame, nodes: DataFrame, params: DataFrame) -> DensityModel:
    return DensityModel(**json.loads(params.head()["value"]), items=items, nodes=nodes)
