"""Exact nearest-neighbour and radius joins (D1-D5, D12, I1, I15 building block).

Catalyst has no index join for vectors: a theta join on distance plans as a
nested loop over all pairs.  Exact strategies are used instead, picked by
the *checked* size of the reference side and by what pivots would prune:

* **broadcast** (reference rows <= ``max_broadcast_rows``): the reference
  matrix is broadcast once; each query partition computes its distances in
  numpy blocks (Arrow batches via ``mapInPandas``) and emits only its top-k.
  No pair rows are ever materialised.
* **blocks** (larger references, where pivots prune little): both sides are
  cut into blocks of ``_BLOCK_BYTES`` of vectors that meet once each.
* **pivot partitioning** (larger references; Voronoi kNN join, Lu et al.,
  VLDB 2012): references are assigned to the nearest of P seeded pivots; per
  cell we keep (count, radius).  For every query an upper bound theta on its
  k-th neighbour distance follows from the nearest cells whose counts reach k;
  by the triangle inequality only cells with d(q, pivot) - radius <= theta can
  hold a neighbour.  Query rows are routed to those cells (an equi-join on the
  cell id), large cells are split into sub-blocks of at most ``block_rows``
  references and query groups are salted the same way, so no group grows with
  a hot cell.  Each (cell, sub-block, salt) group computes a bounded distance
  block and keeps its top-k; a ``row_number`` window (planned as a grouped
  limit) merges them.  The result is exact.

Ties are broken by the smaller reference id, so results do not depend on
partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BROADCAST_ROWS = 200_000
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20
DEFAULT_BLOCK_ROWS = 4096
#: bytes of the temporary arrays of one numpy block
_BLOCK_BYTES = 32 << 20
#: queries and references of a tile of bounds
_TILE = 256, 2048
#: pairs that a run of queries keeps before they are measured
_KEPT = 1 << 19
#: a row that is dealt to a group costs about as much as so many pairs
_ROW_PAIRS = 4096


def _mat(s: pd.Series) -> np.ndarray:
    if len(s) == 0:
        return np.zeros((0, 0))
    return np.stack(s.to_numpy()).astype(np.float64)


def arrow_mat(column) -> np.ndarray:
    """The equally long lists of an Arrow column as a matrix, a missing number as NaN; no list becomes an object on the way."""
    if column.null_count or len(np.unique(np.concatenate([c.value_lengths().to_numpy() for c in column.chunks] or [np.zeros(0)]))) != 1:
        return _mat(column.to_pandas())
    values = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in column.chunks]
    return np.concatenate(values).reshape(len(column), -1)


def _exact_dist(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """All distances by differences; the differences of at most ``_BLOCK_BYTES`` exist at a time."""
    out = np.empty((len(q), len(r)))
    width = max(1, q.shape[1] if q.ndim > 1 else 1)
    cols = max(1, min(len(r), _BLOCK_BYTES // (8 * width)))
    rows = max(1, _BLOCK_BYTES // (8 * width * cols))
    for i in range(0, len(q), rows):
        for j in range(0, len(r), cols):
            diff = q[i:i + rows, None, :] - r[None, j:j + cols, :]
            out[i:i + rows, j:j + cols] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _pair_dist(q: np.ndarray, r: np.ndarray, qi: np.ndarray, ri: np.ndarray, as_exact: bool = False) -> np.ndarray:
    """Distances of the pairs (qi, ri) by differences, in bounded runs of pairs; ``as_exact``: rounded as by ``_exact_dist``."""
    out = np.empty(len(qi))
    step = max(1, _BLOCK_BYTES // (8 * max(1, q.shape[1])))
    for s in range(0, len(qi), step):
        e = s + step
        diff = r[ri[s:e]] - q[qi[s:e]]
        out[s:e] = np.sqrt(np.einsum("ij,ij->i", diff, diff) if as_exact else (diff**2).sum(axis=1))
    return out


class _Bounds:
    """Lower bounds of squared distances to the references, by one matrix product for each tile.

    |r|^2 - 2 q.r on data moved to the references' mean is the squared distance less |q|^2.  What rounding
    may add, here and in a distance by differences, is at most ``slack`` * (|q|^2 + |r|^2), so with that taken
    off both squares the product is a lower bound, and outliers weaken the bounds of their own pairs only.
    """

    def __init__(self, rv: np.ndarray):
        self.centre = rv.mean(axis=0)
        self.slack = 16 * (rv.shape[1] + 8) * np.finfo(np.float64).eps
        rc = rv - self.centre
        self.rn = np.einsum("ij,ij->i", rc, rc)
        self.r = np.column_stack([rc, (1 - self.slack) * self.rn])

    def runs(self, qv: np.ndarray) -> Iterator[tuple]:
        """(first row, |q|^2, |q|^2 less its slack, tiles (first reference, bounds less that)) of each run of rows."""
        for s in range(0, len(qv), _TILE[0]):
            qc = qv[s:s + _TILE[0]] - self.centre
            qn = np.einsum("ij,ij->i", qc, qc)
            q = np.column_stack([-2 * qc, np.ones(len(qc))])
            yield s, qn, (1 - self.slack) * qn, ((b, q @ self.r[b:b + _TILE[1]].T) for b in range(0, len(self.r), _TILE[1]))


def topk_block(qv: np.ndarray, qids: np.ndarray, rv: np.ndarray, rids: np.ndarray, k: int,
               exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-k (distance, ref id) per query of one block, exact.

    Bounds only rule references out: every reference whose lower bound is no more than the k-th smallest
    upper bound met so far stays, however many there are (equal points all stay).  What stays is measured
    by differences and ordered by (distance, ref id), so ties never depend on blocks or batches.
    Returns flat arrays (query position, ref position, distance).
    """
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if qv.shape[0] == 0 or rv.shape[0] == 0 or k <= 0:
        return none
    bounds, top, found = _Bounds(rv), np.finfo(np.float64).max, []

    def nearest(s: int, qi: np.ndarray, ri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dist = _pair_dist(qv, rv, qi + s, ri)
        order = np.lexsort((rids[ri], dist, qi))
        qi, ri, dist = qi[order], ri[order], dist[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        return qi[keep], ri[keep], dist[keep]

    for s, qn, ql, tiles in bounds.runs(qv):
        ids = qids[s:s + len(qn)]
        best = np.full((len(qn), k), np.inf)  # the k smallest upper bounds so far, their largest first
        kept, many = [], 0
        for b, low in tiles:
            n = low.shape[1]
            if exclude_self:
                low[rids[None, b:b + n] == ids[:, None]] = np.inf
            limit = np.minimum(best[:, 0], top) - ql  # infinite ones are out
            if k < n and not np.isfinite(best[:, 0]).all():  # the tile's own k-th
                own = np.partition(low, k - 1, axis=1)[:, k - 1]
                limit = np.minimum(limit, own + 2 * bounds.slack * (qn + bounds.rn[b:b + n].max()))
            at = np.flatnonzero(low <= limit[:, None])
            if not len(at):
                continue
            qi, ri = np.divmod(at, n)
            value = low.ravel()[at] + ql[qi]
            ri += b
            head = np.flatnonzero(np.diff(qi, prepend=-1))
            count = np.diff(head, append=len(qi))
            more = np.full((len(head), k + int(count.max())), np.inf)
            more[:, :k] = best[qi[head]]
            more[np.repeat(np.arange(len(head)), count), k + np.arange(len(qi)) - np.repeat(head, count)] = (
                value + 2 * bounds.slack * (qn[qi] + bounds.rn[ri]))
            best[qi[head]] = np.partition(more, k - 1, axis=1)[:, k - 1::-1]
            kept.append((qi, ri, value))
            many += len(qi)
            if many > _KEPT + k * len(qn):  # many equal distances: only the first k of each row can stay
                qi, ri, value = (np.concatenate(x) for x in zip(*kept, strict=True))
                stay = value <= np.minimum(best[:, 0], top)[qi]
                qi, ri, dist = nearest(s, qi[stay], ri[stay])
                kept, many = [(qi, ri, np.full(len(qi), -np.inf))], len(qi)
        if kept:
            qi, ri, value = (np.concatenate(x) for x in zip(*kept, strict=True))
            stay = value <= np.minimum(best[:, 0], top)[qi]
            qi, ri, dist = nearest(s, qi[stay], ri[stay])
            found.append((qi + s, ri, dist))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


def within_block(qv: np.ndarray, rv: np.ndarray, eps: float, count_only: bool = False):
    """References within ``eps`` of each query of one block, exact: their number, or flat arrays (query
    position, ref position, distance).

    Bounds decide all pairs but those that rounding may put on either side of ``eps``; these are measured
    by differences, as are all pairs that are handed on.  Rows with values that aren't finite are at no finite distance.
    """
    qk, rk = (np.flatnonzero(np.isfinite(v).all(axis=1)) if np.isfinite(eps) else np.arange(len(v)) for v in (qv, rv))
    q, r = qv[qk], rv[rk]
    counts, found = np.zeros(len(qv), np.int64), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if len(q) and len(r):
        bounded = 0 <= eps < 1e150 and max(np.abs(q).max(), np.abs(r).max()) < 1e150  # squares don't overflow
        bounds = _Bounds(r if bounded else np.zeros_like(r))
        for s, qn, ql, tiles in bounds.runs(q if bounded else np.zeros_like(q)):
            for b, low in tiles:
                limit = eps * eps - ql if bounded else np.full(len(qn), np.inf)
                some = low <= limit[:, None]
                if count_only and bounded:
                    sure = low <= (limit - 2 * bounds.slack * (qn + bounds.rn[b:b + low.shape[1]].max()))[:, None]
                    counts[qk[s:s + len(qn)]] += np.count_nonzero(sure, axis=1)
                    some ^= sure
                qi, ri = np.divmod(np.flatnonzero(some), low.shape[1])
                dist = _pair_dist(q, r, qi + s, ri + b, True)
                near = np.flatnonzero(dist <= eps)
                if count_only:
                    counts[qk] += np.bincount(qi[near] + s, minlength=len(qk))
                else:
                    found.append((qk[qi[near] + s], rk[ri[near] + b], dist[near]))
    return counts if count_only else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def dealt(rows: DataFrame, against: int) -> DataFrame:
    """Rows in several tasks for each core, if they meet many others: a file of few row groups is read by few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism) if against > _TILE[1] else rows


def _ref_table(refs: DataFrame, rid: str, rvec: str, payload: Sequence[str]) -> DataFrame:
    return refs.select(F.col(rid).cast("long").alias("__rid"), F.col(rvec).alias("__rvec"), *payload)


def _payload_fields(refs: DataFrame, payload: Sequence[str]) -> list[T.StructField]:
    return [refs.schema[p] for p in payload]


def knn(queries: DataFrame, refs: DataFrame, k: int, *, qid: str = "row_index", rid: str = "row_index",
        qvec: str = "features", rvec: str = "features", payload: Sequence[str] = (), exclude_self: bool = False,
        max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, block_rows: int = DEFAULT_BLOCK_ROWS,
        n_pivots: int | None = None, strategy: str | None = None) -> DataFrame:
    """Exact k nearest references per query row.

    Returns (row_index, rank, nbr_index, distance, *payload); rank is 1-based.
    Queries with fewer than k references available get what exists.
    """
    payload = list(payload)
    r = _ref_table(refs, rid, rvec, payload)
    if strategy is None:
        strategy = _pick(r, max_broadcast_rows)
    q = queries.select(F.col(qid).cast("long").alias("__qid"), F.col(qvec).alias("__qvec"))
    out_fields = [T.StructField("row_index", T.LongType()), T.StructField("rank", T.IntegerType()),
                  T.StructField("nbr_index", T.LongType()), T.StructField("distance", T.DoubleType())]
    out_fields += _payload_fields(r, payload)
    schema = T.StructType(out_fields)
    if strategy == "broadcast":
        return _knn_broadcast(q, r, k, payload, exclude_self, schema)
    return _knn_groups(q, r, k, payload, exclude_self, schema, block_rows, n_pivots, strategy)


def _pick(r: DataFrame, max_rows: int, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> str:
    """Broadcast only under a checked bound on rows and on bytes (rows x width x 8)."""
    st = r.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__rvec")).alias("w")).head()
    n, w = st["n"], st["w"] or 0
    return "broadcast" if n <= max_rows and n * max(w, 1) * 8 <= max_bytes else "groups"


def _collect_refs(r: DataFrame, payload: Sequence[str]):
    table = r.toArrow()
    return arrow_mat(table.column("__rvec")), table.column("__rid").to_numpy(), {p: table.column(p).to_pandas().to_numpy() for p in payload}


def _knn_broadcast(q: DataFrame, r: DataFrame, k: int, payload: Sequence[str], exclude_self: bool,
                   schema: T.StructType) -> DataFrame:
    spark = q.sparkSession
    rv, rids, pay = _collect_refs(r, payload)
    bc = spark.sparkContext.broadcast((rv, rids, pay))

    def run(it):
        rv_, rids_, pay_ = bc.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            qv = _mat(pdf["__qvec"])
            qids = pdf["__qid"].to_numpy(np.int64)
            qi, ri, d = topk_block(qv, qids, rv_, rids_, k, exclude_self)
            out = pd.DataFrame({"row_index": qids[qi], "nbr_index": rids_[ri], "distance": d})
            out["rank"] = out.groupby("row_index").cumcount().astype("int32") + 1
            for p in payload:
                out[p] = pay_[p][ri]
            yield out[[f.name for f in schema.fields]]

    return dealt(q, len(rids)).mapInPandas(run, schema)


# ------------------------------------------------------------------ pivot strategy

def _choose_pivots(r: DataFrame, n_pivots: int, seed: int = 42) -> np.ndarray:
    """Seeded pivots: the references with the smallest hash (top-k plan, no full sort)."""
    rows = (r.select("__rvec", F.xxhash64(F.col("__rid"), F.lit(seed)).alias("__h"), "__rid")
            .orderBy("__h", "__rid").limit(n_pivots).toPandas())
    return _mat(rows["__rvec"])


def assign_cells(r: DataFrame, pivots: np.ndarray, vec: str = "__rvec") -> DataFrame:
    """Attach (cell, dpiv): nearest pivot and the distance to it."""
    spark = r.sparkSession
    bc = spark.sparkContext.broadcast(pivots)
    schema = T.StructType(r.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("dpiv", T.DoubleType())])

    def run(it):
        pv = bc.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = _mat(pdf[vec])
            d = _exact_dist(x, pv) if x.shape[0] * pv.shape[0] <= 4_000_000 else np.vstack(
                [_exact_dist(x[s:s + 512], pv) for s in range(0, x.shape[0], 512)])
            c = d.argmin(axis=1)
            pdf = pdf.copy()
            pdf["cell"] = c.astype("int32")
            pdf["dpiv"] = d[np.arange(len(c)), c]
            yield pdf

    return r.mapInPandas(run, schema)


def _route_queries(q: DataFrame, pivots: np.ndarray, stats: pd.DataFrame, need: int | None,
                   radius: float | None, count_only: bool = False) -> DataFrame:
    """Emit (qid, qvec, cell) for every cell that may hold a neighbour of the query; or (cell, n), partial numbers of queries.

    ``need`` > 0: kNN bound (theta from the nearest cells whose counts reach need);
    ``radius``: fixed search radius.
    """
    spark = q.sparkSession
    cnt = np.zeros(len(pivots), dtype=np.int64)
    rad = np.zeros(len(pivots))
    cnt[stats["cell"].to_numpy()] = stats["n"].to_numpy()
    rad[stats["cell"].to_numpy()] = stats["radius"].to_numpy()
    bc = spark.sparkContext.broadcast((pivots, cnt, rad))
    schema = "cell int, n long" if count_only else T.StructType(q.schema.fields + [T.StructField("cell", T.IntegerType())])

    def run(it):
        pv, cn, ra = bc.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = _mat(pdf["__qvec"])
            d = np.vstack([_exact_dist(x[s:s + 512], pv) for s in range(0, x.shape[0], 512)])
            rows_q, rows_c = [], []
            for i in range(x.shape[0]):
                if radius is not None:
                    theta = radius
                else:
                    order = np.argsort(d[i], kind="stable")
                    cum = np.cumsum(cn[order])
                    j = int(np.searchsorted(cum, need))
                    j = min(j, len(order) - 1)
                    theta = float(np.max(d[i, order[:j + 1]] + ra[order[:j + 1]]))
                cells = np.nonzero((d[i] - ra <= theta * (1 + 1e-12) + 1e-12) & (cn > 0))[0]
                rows_q.append(np.full(len(cells), i))
                rows_c.append(cells)
            if count_only:
                n = np.bincount(np.concatenate(rows_c), minlength=len(pv))
                yield pd.DataFrame({"cell": np.flatnonzero(n).astype("int32"), "n": n[n > 0]})
                continue
            qi = np.concatenate(rows_q) if rows_q else np.zeros(0, int)
            out = pdf.iloc[qi].reset_index(drop=True)
            out["cell"] = np.concatenate(rows_c).astype("int32") if rows_c else np.zeros(0, "int32")
            yield out

    return q.mapInPandas(run, schema)


def _blocked_groups(q_routed: DataFrame, r_cells: DataFrame, nref: dict[int, int], nquery: dict[int, int], block_rows: int
                    ) -> tuple[DataFrame, DataFrame]:
    """Split cells into reference sub-blocks and salt query groups, both bounded by block_rows."""
    nsub = {c: max(1, math.ceil(n / block_rows)) for c, n in nref.items()}
    nsalt = {c: max(1, math.ceil(n / block_rows)) for c, n in nquery.items()}
    sub_map = F.create_map(*[x for c, n in nsub.items() for x in (F.lit(c), F.lit(n))]) if nsub else F.create_map()
    salt_map = F.create_map(*[x for c, n in nsalt.items() for x in (F.lit(c), F.lit(n))]) if nsalt else F.create_map()
    ns = F.coalesce(F.element_at(sub_map, F.col("cell")), F.lit(1))
    nq = F.coalesce(F.element_at(salt_map, F.col("cell")), F.lit(1))
    r2 = (r_cells.withColumn("sub", F.pmod(F.xxhash64("__rid"), ns.cast("long")).cast("int"))
          .withColumn("salt", F.explode(F.sequence(F.lit(0), nq - 1))))
    q2 = (q_routed.withColumn("salt", F.pmod(F.xxhash64("__qid"), nq.cast("long")).cast("int"))
          .withColumn("sub", F.explode(F.sequence(F.lit(0), ns - 1))))
    return q2, r2


def _meeting(q: DataFrame, r: DataFrame, n_pivots: int | None, block_rows: int, strategy: str, need: int | None,
             radius: float | None) -> tuple[DataFrame, DataFrame]:
    """Queries and references with (cell, sub, salt), such that every pair that may count meets in one group.

    Of pivots and blocks that one is taken which costs less, where ``strategy`` names neither.
    """
    found = r.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__rvec")).alias("w")).head()
    n_ref, block = found["n"], max(block_rows, _BLOCK_BYTES // (8 * max(1, found["w"] or 0)))
    if strategy != "blocks":
        pivots, r_cells, stats = _pivot_setup(q, r, n_ref, n_pivots, block_rows)
        number = _route_queries(dealt(q, n_ref), pivots, stats, need=need, radius=radius, count_only=True)
        nref = {int(c): int(n) for c, n in zip(stats["cell"], stats["n"])}
        nquery = {int(row["cell"]): int(row["n"]) for row in number.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n_query = q.count()
    if strategy == "groups":
        blocks = lambda n, size: max(1, math.ceil(n / size))
        rows = sum(nquery[c] * blocks(nref[c], block_rows) + nref[c] * blocks(nquery[c], block_rows) for c in nquery)
        plain = n_query * blocks(n_ref, block) + n_ref * blocks(n_query, block)
        pairs = sum(nquery[c] * nref[c] for c in nquery)
        strategy = "blocks" if plain * _ROW_PAIRS + n_query * n_ref < rows * _ROW_PAIRS + pairs else "pivot"
    if strategy == "blocks":
        one = F.lit(0).alias("cell")
        return _blocked_groups(q.select("*", one), r.select("*", one), {0: n_ref}, {0: n_query}, block)
    routed = _route_queries(dealt(q, n_ref), pivots, stats, need=need, radius=radius)
    return _blocked_groups(routed, r_cells.drop("dpiv"), nref, nquery, block_rows)


def _pivot_setup(q: DataFrame, r: DataFrame, n_ref: int, n_pivots: int | None, block_rows: int):
    p = n_pivots or max(1, min(4096, int(math.ceil(n_ref / block_rows)) * 4))
    pivots = _choose_pivots(r, p)
    r_cells = assign_cells(dealt(r, n_ref), pivots)
    stats = r_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dpiv").alias("radius")).toPandas()
    return pivots, r_cells, stats


def _knn_groups(q: DataFrame, r: DataFrame, k: int, payload: Sequence[str], exclude_self: bool,
                schema: T.StructType, block_rows: int, n_pivots: int | None, strategy: str) -> DataFrame:
    q2, r2 = _meeting(q, r, n_pivots, block_rows, strategy, need=k + (1 if exclude_self else 0), radius=None)
    part_schema = T.StructType([f for f in schema.fields if f.name != "rank"])

    def block(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({f.name: [] for f in part_schema.fields})
        qids = qpdf["__qid"].to_numpy(np.int64)
        rids = rpdf["__rid"].to_numpy(np.int64)
        qi, ri, d = topk_block(_mat(qpdf["__qvec"]), qids, _mat(rpdf["__rvec"]), rids, k, exclude_self)
        out = pd.DataFrame({"row_index": qids[qi], "nbr_index": rids[ri], "distance": d})
        for p in payload:
            out[p] = rpdf[p].to_numpy()[ri]
        return out

    keys = ["cell", "sub", "salt"]
    parts = q2.groupBy(*keys).cogroup(r2.groupBy(*keys)).applyInPandas(block, part_schema)
    w = Window.partitionBy("row_index").orderBy("distance", "nbr_index")
    ranked = parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*[f.name for f in schema.fields])


# ------------------------------------------------------------------ radius queries

def radius_neighbors(queries: DataFrame, refs: DataFrame, eps: float, *, qid: str = "row_index",
                     rid: str = "row_index", qvec: str = "features", rvec: str = "features",
                     count_only: bool = False, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                     block_rows: int = DEFAULT_BLOCK_ROWS, n_pivots: int | None = None,
                     strategy: str | None = None) -> DataFrame:
    """All references within ``eps`` (inclusive) of each query, self included.

    ``count_only``: (row_index, n_within) — partial counts per block, summed.
    Otherwise (row_index, nbr_index, distance) — the pairs *are* the result.
    """
    r = _ref_table(refs, rid, rvec, [])
    q = queries.select(F.col(qid).cast("long").alias("__qid"), F.col(qvec).alias("__qvec"))
    if strategy is None:
        strategy = _pick(r, max_broadcast_rows)
    pair_schema = T.StructType([T.StructField("row_index", T.LongType()), T.StructField("nbr_index", T.LongType()),
                                T.StructField("distance", T.DoubleType())])
    cnt_schema = T.StructType([T.StructField("row_index", T.LongType()), T.StructField("n_within", T.LongType())])
    schema = cnt_schema if count_only else pair_schema

    def emit(qids, qv, rids, rv):
        if count_only:
            return pd.DataFrame({"row_index": qids, "n_within": within_block(qv, rv, eps, True)})
        qi, ri, d = within_block(qv, rv, eps)
        return pd.DataFrame({"row_index": qids[qi], "nbr_index": rids[ri], "distance": d})

    if strategy == "broadcast":
        rv, rids, _ = _collect_refs(r, [])
        bc = q.sparkSession.sparkContext.broadcast((rv, rids))

        def run(it):
            rv_, rids_ = bc.value
            for pdf in it:
                if len(pdf):
                    yield emit(pdf["__qid"].to_numpy(np.int64), _mat(pdf["__qvec"]), rids_, rv_)

        return dealt(q, len(rids)).mapInPandas(run, schema)

    q2, r2 = _meeting(q, r, n_pivots, block_rows, strategy, need=None, radius=eps)

    def block(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return emit(qpdf["__qid"].to_numpy(np.int64), _mat(qpdf["__qvec"]), rpdf["__rid"].to_numpy(np.int64),
                    _mat(rpdf["__rvec"]))

    keys = ["cell", "sub", "salt"]
    parts = q2.groupBy(*keys).cogroup(r2.groupBy(*keys)).applyInPandas(block, schema)
    if count_only:
        return parts.groupBy("row_index").agg(F.sum("n_within").cast("long").alias("n_within"))
    return parts
