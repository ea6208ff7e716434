"""Exact distributed quantiles by histogram refinement.

Spark's exact ``percentile`` merges every distinct value of a group in one
task; at scale that is an unbounded group.  Here each target order statistic
is located by repeated bucket counting instead:

1. one aggregate gives (n, min, max) per key;
2. every pass counts the values inside the current interval of every open
   target into ``n_buckets`` equal-width buckets (map-side partial
   aggregation; the output is bounded by targets x buckets);
3. the bucket holding the target rank becomes the next interval; when it holds
   at most ``leaf_rows`` values, or a single distinct value, those values are
   fetched (bounded) and the exact element is picked.

Quantiles interpolate linearly between the order statistics at floor(h) and
ceil(h), h = (n - 1) p — the ``quantile_cont`` / numpy default definition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TARGETS = T.StructType([
    T.StructField("tid", T.IntegerType()),
    T.StructField("key", T.StringType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
])


def order_statistics(long_df: DataFrame, targets: dict[tuple[str, int], None] | Sequence[tuple[str, int]], *,
                     key: str = "key", value: str = "value", n_buckets: int = 4096,
                     leaf_rows: int = 50_000, bounds: dict[str, tuple[float, float]] | None = None,
                     counts: dict[str, int] | None = None, ranks: dict | None = None) -> dict[tuple[str, int], float]:
    """Exact k-th smallest (0-based) non-null value per (key, k).

    A key whose whole value set is at most ``leaf_rows`` is fetched in one
    bounded pass instead of being bucketed first.  When ``ranks`` is a dict it
    receives, per target, (number of values < result, number of values <= result).
    """
    spark = long_df.sparkSession
    base = long_df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    if bounds is None or counts is None:
        st = base.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        bounds = {r["key"]: (r["lo"], r["hi"]) for r in st}
        counts = {r["key"]: r["n"] for r in st}
    # open target: [key, rank, lo, hi, below]
    open_t = {}
    for i, (k, r) in enumerate(targets):
        lo, hi = bounds[k]
        open_t[i] = [k, int(r), lo, hi, 0]
    labels = list(targets)
    result: dict[tuple[str, int], float] = {}
    first = True
    while open_t:
        if first:
            first = False
            small = {tid: (t[2], t[3], 0) for tid, t in open_t.items() if counts.get(t[0], leaf_rows + 1) <= leaf_rows}
            if small:
                _fetch(spark, base, open_t, small, labels, result, ranks)
                continue
        # targets sharing an interval share one histogram (first pass: one per key)
        iids: dict[tuple[str, float, float], int] = {}
        for t in open_t.values():
            iids.setdefault((t[0], t[2], t[3]), len(iids))
        # bucket budget: the collected histogram stays bounded however many targets are open
        nb = max(16, min(n_buckets, _HIST_BUDGET // max(1, len(iids))))
        hist = _histogram(spark, base, iids, nb).collect()
        per: dict[int, list] = {}
        for h in hist:
            per.setdefault(h["tid"], []).append((h["b"], h["cnt"], h["bmin"], h["bmax"]))
        for v in per.values():
            v.sort()
        fetch: dict[int, tuple[float, float, int]] = {}
        for tid in list(open_t):
            k, rank, lo, hi, below = open_t[tid]
            cum = below
            for b, cnt, bmin, bmax in per.get(iids[(k, lo, hi)], []):
                if cum + cnt > rank:
                    if bmin == bmax:
                        result[labels[tid]] = float(bmin)
                        del open_t[tid]
                    elif cnt <= leaf_rows:
                        fetch[tid] = (bmin, bmax, cum)
                    else:
                        open_t[tid] = [k, rank, bmin, bmax, cum]
                    break
                cum += cnt
        if fetch:
            _fetch(spark, base, open_t, fetch, labels, result, ranks)
    return result


_HIST_BUDGET = 1 << 20
_JOIN_INTERVALS_PER_KEY = 64


def _assign_intervals(spark, base: DataFrame, iids: dict[tuple[str, float, float], int]) -> DataFrame:
    """(tid, lo, hi, value) for values inside an open interval.

    Few intervals per key: broadcast equi-join on the key plus a range filter.
    Many (quantile grids): intervals of a key are disjoint, so each value finds
    its interval by binary search against broadcast sorted bounds in an Arrow
    batch — no per-interval fan-out.
    """
    per_key: dict[str, list] = {}
    for (k, lo, hi), i in iids.items():
        per_key.setdefault(k, []).append((lo, hi, i))
    if max(len(v) for v in per_key.values()) <= _JOIN_INTERVALS_PER_KEY:
        tdf = spark.createDataFrame([(i, k, float(lo), float(hi)) for (k, lo, hi), i in iids.items()], _TARGETS)
        return base.join(F.broadcast(tdf), "key").where(F.col("value").between(F.col("lo"), F.col("hi")))
    import numpy as np
    import pandas as pd

    tables = {}
    for k, v in per_key.items():
        v.sort()
        tables[k] = (np.array([a for a, _, _ in v]), np.array([b for _, b, _ in v]), np.array([i for _, _, i in v]))
    bc = spark.sparkContext.broadcast(tables)

    def run(it):
        tb = bc.value
        for pdf in it:
            outs = []
            for k, g in pdf.groupby("key"):
                if k not in tb:
                    continue
                lo, hi, ids = tb[k]
                v = g["value"].to_numpy()
                pos = np.searchsorted(lo, v, side="right") - 1
                ok = (pos >= 0) & (v <= hi[np.maximum(pos, 0)])
                outs.append(pd.DataFrame({"key": k, "value": v[ok], "tid": ids[pos[ok]].astype("int32"),
                                          "lo": lo[pos[ok]], "hi": hi[pos[ok]]}))
            if outs:
                yield pd.concat(outs)

    return base.mapInPandas(run, "key string, value double, tid int, lo double, hi double")


def _histogram(spark, base: DataFrame, iids: dict, n_buckets: int) -> DataFrame:
    inside = _assign_intervals(spark, base, iids)
    width = (F.col("hi") - F.col("lo")) / n_buckets
    bucket = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(n_buckets - 1))).otherwise(0)
    return inside.groupBy("tid", bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("value").alias("bmin"), F.max("value").alias("bmax"))


def _fetch(spark, base: DataFrame, open_t: dict, fetch: dict, labels: list, result: dict, ranks: dict | None = None) -> None:
    """Pull the (bounded) values of each target interval and pick the exact element."""
    fids: dict[tuple[str, float, float], int] = {}
    for tid, (bmin, bmax, _) in fetch.items():
        fids.setdefault((open_t[tid][0], bmin, bmax), len(fids))
    vals = (_assign_intervals(spark, base, fids)
            .groupBy("tid").agg(F.array_sort(F.collect_list("value")).alias("vs")).collect())
    got_vals = {r["tid"]: r["vs"] for r in vals}
    for tid, (bmin, bmax, below) in fetch.items():
        vs = got_vals[fids[(open_t[tid][0], bmin, bmax)]]
        val = float(vs[open_t[tid][1] - below])
        result[labels[tid]] = val
        if ranks is not None:
            import bisect

            ranks[labels[tid]] = (below + bisect.bisect_left(vs, val), below + bisect.bisect_right(vs, val))
        del open_t[tid]


def exact_quantiles(long_df: DataFrame, probs: Sequence[float], *, key: str = "key", value: str = "value",
                    stats: dict[str, tuple[int, float, float]] | None = None, **kw) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per key: {key: [q(p) for p in probs]}.

    ``stats`` ({key: (n, min, max)} of the non-null values) skips the first pass
    when the caller already aggregated them.
    """
    base = long_df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    if stats is None:
        rows = base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        stats = {r["key"]: (r["n"], r["lo"], r["hi"]) for r in rows}
    stats = {k: v for k, v in stats.items() if v[0]}
    ns = {k: v[0] for k, v in stats.items()}
    bounds = {k: (v[1], v[2]) for k, v in stats.items()}
    want: dict[tuple[str, int], None] = {}
    for k, n in ns.items():
        for p in probs:
            h = (n - 1) * p
            want[(k, math.floor(h))] = None
            want[(k, math.ceil(h))] = None
    got = order_statistics(base, list(want), bounds=bounds, counts=ns, **kw) if want else {}
    out: dict[str, list[float | None]] = {}
    for k, n in ns.items():
        qs = []
        for p in probs:
            h = (n - 1) * p
            lo, hi = got[(k, math.floor(h))], got[(k, math.ceil(h))]
            qs.append(lo + (h - math.floor(h)) * (hi - lo))
        out[k] = qs
    return out


def exact_median_by_column(df: DataFrame, columns: Sequence[str], **kw) -> dict[str, float | None]:
    """Median of each column (NULL/NaN skipped), via one unpivot + refinement."""
    long_df = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("value"))
                                            for c in columns])).alias("kv")).select("kv.key", "kv.value")
    q = exact_quantiles(long_df, [0.5], **kw)
    return {c: (q[c][0] if c in q else None) for c in columns}
