"""Neighbour operators over labelled rows (D1-D4, D11 vote helpers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorum.functions.names import class_name
from quorum.operators.knn import knn


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    """B9."""
    return df.where(F.col(label).isNotNull())


def labeled_neighbors(df: DataFrame, train: DataFrame, k: int = 3, *, vec: str = "features", label: str = "label",
                      **kw) -> DataFrame:
    """D1 long form: (row_index, rank, nbr_index, label, distance); k = min(k, n_labelled).

    ``train`` rows with a label form the reference side; no labels -> no rows.
    """
    refs = labelled(train, label).select("row_index", vec, class_name(F.col(label)).alias("nbr_label"))
    out = knn(df, refs, k, qvec=vec, rvec=vec, payload=["nbr_label"], **kw)
    return out.select("row_index", "rank", "nbr_index", F.col("nbr_label").alias("label"), "distance")


def neighbor_lists(long_nbrs: DataFrame) -> DataFrame:
    """D1 nested form: (row_index, top_neighbors ARRAY<STRUCT<row_index, label, distance>>), ascending.

    Per-row lists are bounded by k, so this grouping never collects a large group.
    """
    s = F.struct("rank", F.struct(F.col("nbr_index").alias("row_index"), "label", "distance").alias("n"))
    return long_nbrs.groupBy("row_index").agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["n"]).alias("top_neighbors"))


def knn_vote(long_nbrs: DataFrame, label_col: str = "nbr_class") -> DataFrame:
    """Uniform vote over the k neighbours, ties -> smaller class: (row_index, predicted)."""
    votes = long_nbrs.groupBy("row_index", label_col).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("row_index").orderBy(F.col("votes").desc(), F.col(label_col).asc())
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("row_index", F.col(label_col).alias("predicted"))


def knn_proba(long_nbrs: DataFrame, classes: list[float], label_col: str = "nbr_class") -> DataFrame:
    """D3: (row_index, class, proba) for every known class (zeros included)."""
    per = long_nbrs.groupBy("row_index").agg(
        F.count(F.lit(1)).alias("k"),
        *[F.count_if(F.col(label_col) == F.lit(c)).alias(f"c{i}") for i, c in enumerate(classes)],
    )
    arr = F.array(*[F.struct(F.lit(float(c)).alias("class"), (F.col(f"c{i}") / F.col("k")).alias("proba"))
                    for i, c in enumerate(classes)])
    return per.select("row_index", F.explode(arr).alias("p")).select("row_index", "p.class", "p.proba")


def knn_classify(df: DataFrame, train: DataFrame, k: int, *, vec: str = "features", label: str = "label",
                 exclude_self: bool = False, **kw) -> DataFrame:
    """D2 end to end: (row_index, predicted) from the k nearest labelled training rows."""
    refs = labelled(train, label).select("row_index", vec, F.col(label).alias("nbr_class"))
    nb = knn(df, refs, k, qvec=vec, rvec=vec, payload=["nbr_class"], exclude_self=exclude_self, **kw)
    return knn_vote(nb)


def knn_loo(df: DataFrame, k: int, *, vec: str = "features", label: str = "label", **kw) -> DataFrame:
    """Leave-one-out kNN on labelled rows: (row_index, label, predicted)."""
    lab = labelled(df, label)
    pred = knn_classify(lab, lab, k, vec=vec, label=label, exclude_self=True, **kw)
    return lab.select("row_index", label).join(pred, "row_index")


def neighbor_arrays(df: DataFrame, refs: DataFrame, k: int, *, vec: str = "features", label: str = "label",
                    max_broadcast_rows: int = 200_000) -> DataFrame:
    """D1 row-local form for streams: each row gets its ``top_neighbors`` array in the
    same Arrow batch pass (broadcast of the size-checked labelled table), so no
    aggregation — and no streaming state — is needed."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from quorum.operators.knn import _mat, topk_block

    lab = labelled(refs, label).select("row_index", vec, class_name(F.col(label)).alias("nbr_label"))
    n = lab.count()
    if n > max_broadcast_rows:
        raise ValueError(f"{n} labelled rows exceed the broadcast bound {max_broadcast_rows}; use labeled_neighbors")
    pdf = lab.toPandas()
    rv = _mat(pdf[vec]) if n else np.zeros((0, 0))
    bc = df.sparkSession.sparkContext.broadcast((rv, pdf["row_index"].to_numpy(np.int64), pdf["nbr_label"].to_numpy()))
    nb_type = T.ArrayType(T.StructType([T.StructField("row_index", T.LongType()), T.StructField("label", T.StringType()),
                                        T.StructField("distance", T.DoubleType())]))
    schema = T.StructType(df.schema.fields + [T.StructField("top_neighbors", nb_type)])

    def run(it):
        rv_, ids_, labs_ = bc.value
        for p in it:
            if len(p) == 0:
                continue
            p = p.copy()
            lists = [[] for _ in range(len(p))]
            if len(ids_):
                qi, ri, d = topk_block(_mat(p[vec]), np.arange(len(p)), rv_, ids_, min(k, len(ids_)), False)
                for a, b, dd in zip(qi, ri, d):
                    lists[a].append({"row_index": int(ids_[b]), "label": str(labs_[b]), "distance": float(dd)})
            p["top_neighbors"] = lists
            yield p

    return df.mapInPandas(run, schema)
