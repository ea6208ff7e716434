"""Exact quantiles of pairwise distances without materialising pairs.

The statistic is defined over every ordered pair (i, j), i != j, of labelled
rows.  Pair distances are computed block by block inside Arrow batches and
never leave the task as rows: each pass emits only per-task summaries —
(count, min, max) per key, then bucket counts per open target interval, and
finally the few values of the target bucket (bounded by ``leaf_rows``).  This
is the histogram refinement of ``quorum.operators.quantiles`` with a pair
stream as its source.

Reference side: a broadcast of the size-checked labelled table; above the
bound, labelled rows are split into hash blocks and every (block, block) pair
meets once in a co-grouped task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.operators.knn import _exact_dist, _mat

_LEAF = 50_000
_BUCKETS = 4096
#: bytes of the distances of one run of rows
_PAIR_BYTES = 8 << 20


def _pairs_block(q: pd.DataFrame, r: pd.DataFrame):
    """Yield (key array, distance array) for one block; key = (class of i, same class)."""
    qx, rx = _mat(q["v"]), _mat(r["v"])
    qi, ri = q["row_index"].to_numpy(), r["row_index"].to_numpy()
    qc, rc = q["c"].to_numpy(), r["c"].to_numpy()
    step = max(1, _PAIR_BYTES // (8 * len(rx)))
    for s in range(0, len(qx), step):
        d = _exact_dist(qx[s:s + step], rx)
        keep = qi[s:s + step, None] != ri[None, :]
        same = qc[s:s + step, None] == rc[None, :]
        cls = np.broadcast_to(qc[s:s + step, None], d.shape)
        yield cls[keep], same[keep], d[keep]


def _run(lab: DataFrame, fn, schema: str, max_broadcast_rows: int, block_rows: int) -> DataFrame:
    n = lab.count()
    if n <= max_broadcast_rows:
        refs = lab.toPandas()
        bc = lab.sparkSession.sparkContext.broadcast(refs)

        def run(it):
            r = bc.value
            for q in it:
                if len(q):
                    out = fn(q, r)
                    if len(out):
                        yield out

        return lab.mapInPandas(run, schema)
    nb = max(1, math.ceil(n / block_rows))
    base = lab.withColumn("blk", F.pmod(F.xxhash64("row_index"), F.lit(nb)).cast("int"))
    q = base.withColumn("rblk", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    r = base.withColumnRenamed("blk", "rblk").withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    return q.groupBy("blk", "rblk").cogroup(r.groupBy("blk", "rblk")).applyInPandas(
        lambda a, b: fn(a, b) if len(a) and len(b) else pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")}), schema)


def pair_distance_quantiles(df: DataFrame, probs=(0.5,), *, vec: str = "features", label: str = "label",
                            max_broadcast_rows: int = 20_000, block_rows: int = 2048) -> DataFrame:
    """(class, same, prob, distance, n_pairs): linear-interpolated quantiles of the
    distances from rows of ``class`` to rows of the same (same=True) or other classes."""
    spark = df.sparkSession
    lab = df.where(F.col(label).isNotNull()).select("row_index", F.col(vec).alias("v"), F.col(label).cast("double").alias("c"))

    def stats(q, r):
        acc = {}
        for cls, same, d in _pairs_block(q, r):
            for key in [(c, b) for c in np.unique(cls).tolist() for b in (False, True)]:
                m = (cls == key[0]) & (same == key[1])
                dd = d[m]
                if len(dd):
                    a = acc.get(key, [0, np.inf, -np.inf])
                    acc[key] = [a[0] + len(dd), min(a[1], dd.min()), max(a[2], dd.max())]
        return pd.DataFrame([(k[0], bool(k[1]), v[0], v[1], v[2]) for k, v in acc.items()], columns=["c", "same", "n", "lo", "hi"])

    st = (_run(lab, stats, "c double, same boolean, n long, lo double, hi double", max_broadcast_rows, block_rows)
          .groupBy("c", "same").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    # targets: (key, rank) with interval and count below
    targets = {}
    for row in st:
        key = (row["c"], row["same"])
        for p in probs:
            h = (row["n"] - 1) * p
            for rank in {math.floor(h), math.ceil(h)}:
                targets[(key, rank)] = [row["lo"], row["hi"], 0]
    found: dict = {}
    while targets:
        ivals = {}
        for (key, _), (lo, hi, _) in targets.items():
            ivals.setdefault((key, lo, hi), len(ivals))
        nbk = max(16, min(_BUCKETS, (1 << 20) // max(1, len(ivals))))
        small = {}
        for (key, rank), (lo, hi, below) in targets.items():
            small.setdefault(ivals[(key, lo, hi)], (key, lo, hi))
        table = dict(small)

        def hist(q, r, table=table, nbk=nbk):
            found = {}  # per interval: count, least and largest value of each bucket
            for cls, same, d in _pairs_block(q, r):
                for iid, (key, lo, hi) in table.items():
                    m = (cls == key[0]) & (same == key[1]) & (d >= lo) & (d <= hi)
                    dd = d[m]
                    if not len(dd):
                        continue
                    w = (hi - lo) / nbk
                    b = np.minimum(np.floor((dd - lo) / w), nbk - 1).astype(int) if w > 0 else np.zeros(len(dd), int)
                    if iid not in found:
                        found[iid] = np.zeros(nbk, np.int64), np.full(nbk, np.inf), np.full(nbk, -np.inf)
                    count, least, most = found[iid]
                    count += np.bincount(b, minlength=nbk)
                    np.minimum.at(least, b, dd)
                    np.maximum.at(most, b, dd)
            rows = [pd.DataFrame({"tid": [], "b": [], "count": [], "min": [], "max": []})]
            for iid, (count, least, most) in found.items():
                at = np.flatnonzero(count)
                rows.append(pd.DataFrame({"tid": iid, "b": at, "count": count[at], "min": least[at], "max": most[at]}))
            return pd.concat(rows[1:] or rows)

        h = (_run(lab, hist, "tid long, b long, count long, min double, max double", max_broadcast_rows, block_rows)
             .groupBy("tid", "b").agg(F.sum("count").alias("cnt"), F.min("min").alias("bmin"), F.max("max").alias("bmax"))
             .collect())
        per: dict = {}
        for x in h:
            per.setdefault(x["tid"], []).append((x["b"], x["cnt"], x["bmin"], x["bmax"]))
        fetch = {}
        for (key, rank), (lo, hi, below) in list(targets.items()):
            cum = below
            for b, cnt, bmin, bmax in sorted(per.get(ivals[(key, lo, hi)], [])):
                if cum + cnt > rank:
                    if bmin == bmax:
                        found[(key, rank)] = bmin
                        del targets[(key, rank)]
                    elif cnt <= _LEAF:
                        fetch[(key, rank)] = (bmin, bmax, cum)
                    else:
                        targets[(key, rank)] = [bmin, bmax, cum]
                    break
                cum += cnt
        if fetch:
            ftab = {i: (k[0], v[0], v[1]) for i, (k, v) in enumerate(fetch.items())}

            def grab(q, r, ftab=ftab):
                rows = []
                for cls, same, d in _pairs_block(q, r):
                    for fid, (key, lo, hi) in ftab.items():
                        m = (cls == key[0]) & (same == key[1]) & (d >= lo) & (d <= hi)
                        if m.any():
                            rows.append(pd.DataFrame({"fid": fid, "d": d[m]}))
                return pd.concat(rows) if rows else pd.DataFrame({"fid": [], "d": []})

            vals = (_run(lab, grab, "fid long, d double", max_broadcast_rows, block_rows)
                    .groupBy("fid").agg(F.array_sort(F.collect_list("d")).alias("vs")).collect())
            got = {v["fid"]: v["vs"] for v in vals}
            for fid, (tk, (bmin, bmax, below)) in enumerate(fetch.items()):
                found[tk] = got[fid][tk[1] - below]
                del targets[tk]
    out = []
    for row in st:
        key = (row["c"], row["same"])
        for p in probs:
            h = (row["n"] - 1) * p
            lo, hi = found[(key, math.floor(h))], found[(key, math.ceil(h))]
            out.append((row["c"], bool(row["same"]), float(p), lo + (h - math.floor(h)) * (hi - lo), int(row["n"])))
    return spark.createDataFrame(out, "class double, same boolean, prob double, distance double, n_pairs long")


def within_between(df: DataFrame, **kw) -> DataFrame:
    """Per class, median within-class and between-class distance (ordered pairs, no diagonal)."""
    q = pair_distance_quantiles(df, (0.5,), **kw)
    return q.groupBy("class").agg(
        F.max(F.when(F.col("same"), F.col("distance"))).alias("within_median"),
        F.max(F.when(~F.col("same"), F.col("distance"))).alias("between_median"),
        F.max(F.when(F.col("same"), F.col("n_pairs"))).alias("n_within"),
        F.max(F.when(~F.col("same"), F.col("n_pairs"))).alias("n_between"))
