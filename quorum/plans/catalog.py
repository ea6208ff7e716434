"""Registered queries over the driver tables and their DuckDB oracles.

Every query reads the parquet tables under ``sf_dir`` (or tables Spark derives
from them) in full.  ``ORACLES`` holds, per query, SQL text that DuckDB runs on
the same tables; doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.functions.rowstats import FEATURE_NAMES
from quorum.operators import explore
from quorum.operators.features import Preprocessor
from quorum.operators.validate import payload_rejects, validation_failures
from quorum.plans.sqlkit import r6, round_doubles, sql_r6
from quorum.sources import stand_ins as si
from quorum.sources.readers import load_summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


# DuckDB building blocks --------------------------------------------------------------

def _long_sql(src: str) -> str:
    """(row_index, i, x) — i is the 0-based dimension."""
    return (f"SELECT row_index, unnest(sensors) AS x, unnest(generate_series(0, len(sensors) - 1)::INTEGER[]) AS i "
            f"FROM ({src})")


def _scaled_long_sql(src: str) -> str:
    return f"""
    WITH long AS ({_long_sql(src)}),
    st AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM long GROUP BY i)
    SELECT l.row_index, l.i, (l.x - st.mu) / CASE WHEN st.sd > 0 THEN st.sd ELSE 1 END AS z
    FROM long l JOIN st USING (i)"""


def scaled(spark: SparkSession, src: DataFrame) -> DataFrame:
    pre = Preprocessor().fit(src)
    return pre.transform(src)


# Phase 0 ------------------------------------------------------------------------------

@register("standardize", f"""
    SELECT row_index, list({sql_r6('z')} ORDER BY i) AS scaled
    FROM ({_scaled_long_sql(si.readings_sql())}) GROUP BY row_index""")
def q_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = si.readings(spark, sf_dir)
    return round_doubles(scaled(spark, r).select("row_index", "scaled"))


_ROWAGG_SQL = f"""
    WITH z AS ({_scaled_long_sql(si.readings_sql())}),
    m AS (SELECT row_index, z, avg(z) OVER (PARTITION BY row_index) AS mu FROM z)
    SELECT row_index,
      {sql_r6('avg(z)')} AS mean, {sql_r6('stddev_pop(z)')} AS std,
      {sql_r6('min(z)')} AS min, {sql_r6('max(z)')} AS max, {sql_r6('max(z) - min(z)')} AS range,
      {sql_r6('CASE WHEN avg((z-mu)*(z-mu)) > 0 THEN avg((z-mu)*(z-mu)*(z-mu)) / pow(avg((z-mu)*(z-mu)), 1.5) END')} AS skew,
      {sql_r6('CASE WHEN avg((z-mu)*(z-mu)) > 0 THEN avg((z-mu)*(z-mu)*(z-mu)*(z-mu)) / pow(avg((z-mu)*(z-mu)), 2) - 3 END')} AS kurtosis,
      {sql_r6('quantile_cont(z, 0.25)')} AS q25, {sql_r6('quantile_cont(z, 0.75)')} AS q75,
      {sql_r6('quantile_cont(z, 0.5)')} AS median
    FROM m GROUP BY row_index"""


@register("row_aggregates", _ROWAGG_SQL)
def q_row_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.features import AggregatesReducer

    s = scaled(spark, si.readings(spark, sf_dir))
    f = AggregatesReducer().fit(s).transform(s)
    return round_doubles(f.select("row_index", *[F.col("features")[i].alias(n) for i, n in enumerate(FEATURE_NAMES)]))


# Phase 1 ------------------------------------------------------------------------------

def _validation_sql() -> str:
    parts = []
    for i in range(si.N_SENSORS):
        c = f'"Sensor {i}"'
        parts.append(f"SELECT row_index, 'Sensor {i}' AS \"column\", 'in_range' AS \"check\", {sql_r6(c)} AS failure_value "
                     f"FROM w WHERE {c} IS NOT NULL AND NOT isnan({c}) AND NOT ({c} BETWEEN -1.05 AND 1.05)")
        parts.append(f"SELECT row_index, 'Sensor {i}', 'not_nullable', {sql_r6(c)} FROM w WHERE {c} IS NULL OR isnan({c})")
    parts.append("SELECT row_index, 'Label', 'isin', " + sql_r6('"Label"') +
                 " FROM w WHERE \"Label\" IS NOT NULL AND NOT isnan(\"Label\") AND \"Label\" NOT IN (1.0, 2.0, 3.0)")
    return f"WITH w AS ({si.amplified_wide_sql()}) " + " UNION ALL ".join(parts)


@register("validation_failures", _validation_sql())
def q_validation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = validation_failures(si.amplified_wide(spark, sf_dir), n_sensors=si.N_SENSORS)
    return f.select("row_index", "column", "check", r6(F.col("failure_case").try_cast("double")).alias("failure_value"))


@register("load_summary", f"""
    SELECT count(*) AS n_rows, count(label) AS n_labeled, count(*) - count(label) AS n_unlabeled
    FROM ({si.readings_sql()})""")
def q_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_summary(si.readings(spark, sf_dir))


@register("label_histogram", f"SELECT label, count(*) AS n FROM ({si.readings_sql()}) GROUP BY label")
def q_label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.label_histogram(si.readings(spark, sf_dir), dropna=False)


def _null_counts_sql() -> str:
    cols = [f"Sensor {i}" for i in range(si.N_SENSORS)] + ["Label"]
    parts = [f"SELECT '{c}' AS \"column\", count(*) - count(\"{c}\") AS n_null FROM w" for c in cols]
    return f"WITH w AS ({si.readings_wide_sql()}) " + " UNION ALL ".join(parts)


@register("null_counts", _null_counts_sql())
def q_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = si.readings_wide(spark, sf_dir)
    return explore.null_counts(w, [c for c in w.columns if c != "row_index"])


@register("corr_matrix", f"""
    WITH long AS ({_long_sql(si.readings_sql())})
    SELECT a.i AS i, b.i AS j, {sql_r6('corr(a.x, b.x)')} AS corr
    FROM long a JOIN long b ON a.row_index = b.row_index AND a.i < b.i GROUP BY a.i, b.i""")
def q_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(explore.corr_matrix(si.readings(spark, sf_dir)))


@register("sensor_histogram", f"""
    WITH long AS ({_long_sql(si.readings_sql())}),
    mm AS (SELECT i, min(x) AS lo, max(x) AS hi FROM long GROUP BY i)
    SELECT l.i AS sensor,
           CAST(CASE WHEN mm.hi > mm.lo THEN least(floor((l.x - mm.lo) / (mm.hi - mm.lo) * 40), 39) ELSE 0 END AS INTEGER) AS bin,
           count(*) AS n
    FROM long l JOIN mm USING (i) GROUP BY ALL""")
def q_sensor_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.sensor_histogram(si.readings(spark, sf_dir), bins=40)


_LI_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("impute_median", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql_r6(f'median({c})')} AS median FROM lineitem" for c in _LI_COLS))
def q_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.quantiles import exact_median_by_column

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    med = exact_median_by_column(li, list(_LI_COLS))
    return round_doubles(spark.createDataFrame([(c, med[c]) for c in _LI_COLS], "column string, median double"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = si.amplified_wide(spark, sf_dir)
    vec = F.array(*[F.col(f"`Sensor {i}`") for i in range(si.N_SENSORS)])
    return (w.select((F.col("row_index") / F.lit(8)).cast("long").alias("request_id"), F.struct("row_index", vec.alias("v")).alias("r"))
            .groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda s: s["v"]).alias("rows")))


def _payload_sql() -> str:
    w = si.amplified_wide_sql()
    vec = "list_value(" + ", ".join(f'"Sensor {i}"' for i in range(si.N_SENSORS)) + ")"
    return f"""
    WITH w AS ({w}),
    r AS (SELECT row_index // 8 AS request_id, row_index - (row_index // 8) * 8 AS pos_hint, row_index, {vec} AS v FROM w),
    p AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY row_index) - 1 AS pos, v FROM r),
    e AS (SELECT request_id, pos, x FROM (SELECT request_id, pos, unnest(v) AS x FROM p)),
    rr AS (SELECT request_id, pos,
             CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) > 1024 THEN 'too_wide'
                  WHEN bool_or(isnan(x) OR isinf(x)) THEN 'non_finite'
                  WHEN bool_or(NOT (x BETWEEN -1.05 AND 1.05)) THEN 'out_of_band'
                  WHEN count(*) <> {si.N_SENSORS} THEN 'wrong_width' END AS reason
           FROM e GROUP BY request_id, pos)
    SELECT request_id, arg_min(reason, pos) AS reason, CAST(min(pos) AS BIGINT) AS bad_row
    FROM rr WHERE reason IS NOT NULL GROUP BY request_id"""


@register("reject_payloads", _payload_sql())
def q_reject_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_rejects(_payloads(spark, sf_dir), width=si.N_SENSORS)





# Phase 2: neighbours ---------------------------------------------------------------------

def _features(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("sensors", "features")


_NB_CTE = f"""
    b AS ({si.blobs_sql()}),
    l AS (SELECT * FROM b WHERE label IS NOT NULL),
    d AS (SELECT q.row_index, r.row_index AS nbr_index, r.label AS nbr_class,
                 list_distance(q.sensors, r.sensors) AS distance FROM b q, l r),
    rk AS (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY distance, nbr_index) AS rank FROM d)"""


@register("labeled_neighbors", f"""
    WITH {_NB_CTE}
    SELECT row_index, CAST(rank AS INTEGER) AS rank, nbr_index, 'CLASS_' || CAST(CAST(nbr_class AS INTEGER) AS VARCHAR) AS label,
           {sql_r6('distance')} AS distance
    FROM rk WHERE rank <= 3""")
def q_labeled_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.neighbors import labeled_neighbors

    b = _features(si.blobs(spark, sf_dir))
    return round_doubles(labeled_neighbors(b, b, 3))


@register("knn_classify", f"""
    WITH {_NB_CTE},
    v AS (SELECT row_index, nbr_class, count(*) AS votes FROM rk WHERE rank <= 5 GROUP BY row_index, nbr_class)
    SELECT row_index, arg_max(nbr_class, votes * 1000 - nbr_class) AS predicted FROM v GROUP BY row_index""")
def q_knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.neighbors import knn_classify

    b = _features(si.blobs(spark, sf_dir))
    return knn_classify(b, b, 5)


@register("knn_proba", f"""
    WITH {_NB_CTE},
    c AS (SELECT unnest([1.0, 2.0, 3.0]) AS class)
    SELECT row_index, class, {sql_r6('count_if(nbr_class = class) / 5.0')} AS proba
    FROM rk, c WHERE rank <= 5 GROUP BY row_index, class""")
def q_knn_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.knn import knn
    from quorum.operators.neighbors import knn_proba, labelled

    b = _features(si.blobs(spark, sf_dir))
    refs = labelled(b).select("row_index", "features", F.col("label").alias("nbr_class"))
    nb = knn(b, refs, 5, payload=["nbr_class"])
    return round_doubles(knn_proba(nb, [1.0, 2.0, 3.0]))


def _ari_sql(src: str, a: str, b: str) -> str:
    """ARI of columns a, b of a relation (SQL text), NULLs dropped."""
    return f"""(
    WITH s AS (SELECT {a} AS a, {b} AS b FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
    c AS (SELECT a, b, count(*) AS n FROM s GROUP BY a, b),
    t AS (SELECT sum(n * (n - 1) / 2.0) AS sc, sum(n) AS n FROM c),
    ra AS (SELECT sum(n * (n - 1) / 2.0) AS sa FROM (SELECT a, sum(n) AS n FROM c GROUP BY a)),
    rb AS (SELECT sum(n * (n - 1) / 2.0) AS sb FROM (SELECT b, sum(n) AS n FROM c GROUP BY b))
    SELECT CASE WHEN t.n IS NULL OR t.n = 0 THEN NULL
                WHEN (ra.sa + rb.sb) / 2.0 - ra.sa * rb.sb / (t.n * (t.n - 1) / 2.0) = 0 THEN 1.0
                ELSE (t.sc - ra.sa * rb.sb / (t.n * (t.n - 1) / 2.0))
                     / ((ra.sa + rb.sb) / 2.0 - ra.sa * rb.sb / (t.n * (t.n - 1) / 2.0)) END AS ari
    FROM t, ra, rb)"""


_LOO_SQL = " UNION ALL ".join(f"""
    SELECT {k} AS k, (SELECT {sql_r6('avg(CAST(predicted = label AS DOUBLE))')} FROM p{k}) AS accuracy,
           (SELECT {sql_r6('ari')} FROM {_ari_sql(f'p{k}', 'predicted', 'label')}) AS ari""" for k in (1, 3, 5))
_LOO_CTES = ",\n".join(f"""
    v{k} AS (SELECT row_index, nbr_class, count(*) AS votes FROM rk WHERE rank <= {k} GROUP BY row_index, nbr_class),
    p{k} AS (SELECT v.row_index, arg_max(v.nbr_class, v.votes * 1000 - v.nbr_class) AS predicted, any_value(l.label) AS label
             FROM v{k} v JOIN l USING (row_index) GROUP BY v.row_index)""" for k in (1, 3, 5))


@register("knn_loo", f"""
    WITH b AS ({si.blobs_sql()}),
    l AS (SELECT * FROM b WHERE label IS NOT NULL),
    d AS (SELECT q.row_index, r.row_index AS nbr_index, r.label AS nbr_class,
                 list_distance(q.sensors, r.sensors) AS distance FROM l q, l r WHERE q.row_index <> r.row_index),
    rk AS (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY distance, nbr_index) AS rank FROM d),
    {_LOO_CTES}
    {_LOO_SQL}""")
def q_knn_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.metrics import accuracy, ari
    from quorum.operators.neighbors import knn_loo

    b = _features(si.blobs(spark, sf_dir))
    rows = []
    for k in (1, 3, 5):
        p = knn_loo(b, k)
        acc = accuracy(p, "predicted", "label").head()["accuracy"]
        a = ari(p, "predicted", "label").head()["ari"]
        rows.append((k, acc, a))
    return round_doubles(spark.createDataFrame(rows, "k int, accuracy double, ari double"))


@register("ari", f"SELECT {sql_r6('ari')} AS ari FROM {_ari_sql('lineitem', 'l_returnflag', 'l_linestatus')}")
def q_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.metrics import ari

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return round_doubles(ari(li, "l_returnflag", "l_linestatus").select("ari"))


@register("score_correlation", f"""
    SELECT {sql_r6('corr(l_quantity, l_extendedprice)')} AS corr_qty_price,
           {sql_r6('corr(l_discount, l_tax)')} AS corr_discount_tax FROM lineitem""")
def q_score_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return round_doubles(li.agg(F.corr("l_quantity", "l_extendedprice").alias("corr_qty_price"),
                                F.corr("l_discount", "l_tax").alias("corr_discount_tax")))


# Phase 3: label maps on a reproducible clustering --------------------------------------------

_LC_SQL = f"SELECT vec_id AS row_index, CAST(label - 1 AS INTEGER) AS cluster_id, {si._sql_label()} AS label FROM embeddings"


def _label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.label_clusters(spark, sf_dir)


def label_map_sql(src: str) -> str:
    return f"""
    WITH s AS ({src}),
    tot AS (SELECT cluster_id, count(*) AS n_total FROM s GROUP BY cluster_id),
    cc AS (SELECT label, count(*) AS class_n FROM s WHERE label IS NOT NULL GROUP BY label),
    per AS (SELECT cluster_id, label, count(*) AS n FROM s WHERE label IS NOT NULL GROUP BY cluster_id, label),
    sc AS (SELECT per.*, n / class_n AS score FROM per JOIN cc USING (label)),
    st AS (SELECT cluster_id, arg_max(label, score * 1e6 - label) AS winner_approx,
                  max(n) / sum(n) AS purity, sum(n) AS n_labeled,
                  string_agg(CAST(label AS VARCHAR) || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY label) AS distribution
           FROM sc GROUP BY cluster_id),
    win AS (SELECT cluster_id, label AS winner FROM (
              SELECT cluster_id, label, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, label ASC) AS r FROM sc)
            WHERE r = 1)
    SELECT t.cluster_id,
           CASE WHEN t.cluster_id = -1 THEN 'NOISE'
                WHEN coalesce(st.n_labeled, 0) = 0 THEN 'UNKNOWN_' || CAST(t.cluster_id AS VARCHAR)
                ELSE 'CLASS_' || CAST(CAST(win.winner AS INTEGER) AS VARCHAR) END AS name,
           (t.cluster_id <> -1 AND coalesce(st.n_labeled, 0) > 0) AS is_known,
           (t.cluster_id = -1) AS is_noise,
           CASE WHEN t.cluster_id <> -1 AND coalesce(st.n_labeled, 0) > 0 THEN {sql_r6('st.purity')} END AS purity,
           CAST(coalesce(st.n_labeled, 0) AS INTEGER) AS n_labeled, CAST(t.n_total AS INTEGER) AS n_total,
           coalesce(st.distribution, '-') AS distribution
    FROM tot t LEFT JOIN st USING (cluster_id) LEFT JOIN win USING (cluster_id)"""


_LM_SQL = label_map_sql(_LC_SQL)


@register("label_map", _LM_SQL)
def q_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.functions.names import map_text
    from quorum.operators.labelmap import build_label_map

    lm = build_label_map(_label_clusters(spark, sf_dir))
    return round_doubles(lm.select(*[c for c in lm.columns if c != "label_distribution"],
                                   map_text(F.col("label_distribution")).alias("distribution")))


@register("cluster_purity", f"""
    WITH s AS ({_LC_SQL}),
    per AS (SELECT cluster_id, label, count(*) AS n FROM s WHERE label IS NOT NULL GROUP BY cluster_id, label)
    SELECT cluster_id, {sql_r6('max(n) / sum(n)')} AS purity, sum(n) AS n_labeled FROM per GROUP BY cluster_id""")
def q_cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.metrics import cluster_purity

    return round_doubles(cluster_purity(_label_clusters(spark, sf_dir)))


@register("low_purity_warnings", f"SELECT cluster_id, name, purity FROM ({_LM_SQL}) WHERE is_known AND purity < 0.6")
def q_low_purity_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.labelmap import build_label_map, low_purity_warnings

    return round_doubles(low_purity_warnings(build_label_map(_label_clusters(spark, sf_dir))).select("cluster_id", "name", "purity"))


@register("cluster_counts", f"""
    SELECT count_if(is_known) AS n_known, count_if(NOT is_known AND NOT is_noise) AS n_unknown,
           count_if(is_noise) AS n_noise FROM ({_LM_SQL})""")
def q_cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.labelmap import build_label_map, cluster_counts

    return cluster_counts(build_label_map(_label_clusters(spark, sf_dir)))


@register("name_codes", f"""
    SELECT cluster_id, name, CAST(CASE WHEN name = 'NOISE' THEN -1
                                       WHEN name LIKE 'CLASS_%' THEN CAST(substr(name, 7) AS INTEGER)
                                       ELSE 1000 + CAST(substr(name, 9) AS INTEGER) END AS INTEGER) AS label_code
    FROM ({_LM_SQL})""")
def q_name_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.labelmap import build_label_map, encode_names

    lm = build_label_map(_label_clusters(spark, sf_dir))
    return encode_names(lm.select("cluster_id", "name"), "name")


# Phase 4: internal metrics, splits, samples -------------------------------------------------

_BC_SQL = f"""
    SELECT b.row_index, b.sensors, c.cluster_id FROM ({si.blobs_sql()}) b JOIN ({_LC_SQL}) c USING (row_index)"""


def _blob_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _features(si.blobs(spark, sf_dir))
    return b.join(_label_clusters(spark, sf_dir).select("row_index", "cluster_id"), "row_index")


@register("silhouette", f"""
    WITH p AS (SELECT * FROM ({_BC_SQL}) WHERE cluster_id <> -1),
    sz AS (SELECT cluster_id, count(*) AS n FROM p GROUP BY cluster_id),
    d AS (SELECT a.row_index, a.cluster_id AS own, b.cluster_id AS other, sum(list_distance(a.sensors, b.sensors)) AS s
          FROM p a, p b GROUP BY ALL),
    m AS (SELECT d.row_index, d.own, d.other, sz.n, d.s FROM d JOIN sz ON sz.cluster_id = d.other),
    ab AS (SELECT row_index, max(CASE WHEN own = other THEN n END) AS n_own,
                  max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a,
                  min(CASE WHEN own <> other THEN s / n END) AS b FROM m GROUP BY row_index)
    SELECT row_index, {sql_r6('CASE WHEN n_own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END')} AS s FROM ab""")
def q_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.metrics import silhouette_rows

    return round_doubles(silhouette_rows(_blob_clusters(spark, sf_dir)))


@register("davies_bouldin", f"""
    WITH p AS (SELECT * FROM ({_BC_SQL}) WHERE cluster_id <> -1),
    long AS (SELECT row_index, cluster_id, unnest(sensors) AS x, unnest(generate_series(1, len(sensors))) AS i FROM p),
    cen AS (SELECT cluster_id, list(mx ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(x) AS mx FROM long GROUP BY ALL) GROUP BY cluster_id),
    sc AS (SELECT p.cluster_id, avg(list_distance(p.sensors, cen.c)) AS s FROM p JOIN cen USING (cluster_id) GROUP BY p.cluster_id),
    cs AS (SELECT cen.cluster_id, cen.c, sc.s FROM cen JOIN sc USING (cluster_id)),
    r AS (SELECT a.cluster_id, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM cs a, cs b
          WHERE a.cluster_id <> b.cluster_id GROUP BY a.cluster_id)
    SELECT {sql_r6('avg(r)')} AS davies_bouldin FROM r""")
def q_davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.metrics import davies_bouldin

    v = davies_bouldin(_blob_clusters(spark, sf_dir))
    return round_doubles(spark.createDataFrame([(v,)], "davies_bouldin double"))


@register("noise_fraction", f"""
    SELECT {sql_r6('avg(CAST(cluster_id = -1 AS DOUBLE))')} AS noise_fraction,
           CAST(count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS INTEGER) AS n_clusters,
           CAST(count(*) AS INTEGER) AS n_points FROM ({_LC_SQL})""")
def q_noise_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.metrics import noise_summary

    return round_doubles(noise_summary(_label_clusters(spark, sf_dir)))


@register("kfold_assignment", f"""
    SELECT row_index, label,
           CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', row_index, 42)), row_index) - 1) % 5 AS INTEGER) AS fold
    FROM ({si.readings_sql()}) WHERE label IS NOT NULL""")
def q_kfold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.splits import labeled_stratified_kfold

    return labeled_stratified_kfold(si.readings(spark, sf_dir), n_splits=5, seed=42)


@register("bootstrap_sample", " UNION ALL ".join(f"""
    SELECT * FROM (SELECT row_index, {run} AS run FROM ({si.readings_sql()})
                   QUALIFY row_number() OVER (ORDER BY md5(concat_ws(':', row_index, {run}, 42)), row_index)
                           <= greatest(2, CAST(floor(0.8 * count(*) OVER ()) AS BIGINT)))""" for run in range(5)))
def q_bootstrap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.splits import subsample_runs

    s = subsample_runs(si.readings(spark, sf_dir), frac=0.8, n_runs=5, seed=42)
    return s.select("row_index", "run")


# Phase 5-6: density building blocks and the density model ------------------------------

_SELF_CTE = f"""
    b AS ({si.blobs_sql()}),
    d AS (SELECT q.row_index, r.row_index AS nbr_index, list_distance(q.sensors, r.sensors) AS distance
          FROM b q, b r WHERE q.row_index <> r.row_index),
    rk AS (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY distance, nbr_index) AS rank FROM d),
    core AS (SELECT row_index, distance AS core_distance FROM rk WHERE rank = 5)"""


@register("core_distance", f"WITH {_SELF_CTE} SELECT row_index, {sql_r6('core_distance')} AS core_distance FROM core")
def q_core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.density import core_distances

    return round_doubles(core_distances(_features(si.blobs(spark, sf_dir)), 5))


@register("mutual_reachability", f"""
    WITH {_SELF_CTE}
    SELECT rk.row_index, rk.nbr_index, {sql_r6('rk.distance')} AS distance,
           {sql_r6('greatest(rk.distance, a.core_distance, c.core_distance)')} AS mreach
    FROM rk JOIN core a ON a.row_index = rk.row_index JOIN core c ON c.row_index = rk.nbr_index WHERE rk.rank <= 5""")
def q_mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.density import mutual_reachability_edges

    return round_doubles(mutual_reachability_edges(_features(si.blobs(spark, sf_dir)), 5))


@register("dbscan_core_points", f"""
    WITH b AS ({si.blobs_sql()})
    SELECT q.row_index, count(*) AS n_within, count(*) >= 5 AS is_core
    FROM b q, b r WHERE list_distance(q.sensors, r.sensors) <= 0.5 GROUP BY q.row_index""")
def q_dbscan_core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.knn import radius_neighbors

    b = _features(si.blobs(spark, sf_dir))
    c = radius_neighbors(b, b, 0.5, count_only=True)
    return c.select("row_index", "n_within", (F.col("n_within") >= 5).alias("is_core"))


def _density_fit(spark: SparkSession, sf_dir: str):
    from quorum.operators.density import DensityModel
    from quorum.operators.features import AggregatesReducer

    b = si.blobs(spark, sf_dir)
    pre = Preprocessor().fit(b)
    s = pre.transform(b)
    feats = s.withColumn("features", F.col("scaled"))
    model = DensityModel(min_cluster_size=10, min_samples=5).fit(feats)
    return feats, model


@register("density_labels")
def q_density_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4-I8 on the standardised blobs: (row_index, cluster_id, probability, outlier_score)."""
    _, model = _density_fit(spark, sf_dir)
    return round_doubles(model.labels)


@register("density_scores")
def q_density_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted model scores every row of the table again."""
    feats, model = _density_fit(spark, sf_dir)
    return round_doubles(model.score(feats.select("row_index", "features")).drop("features"))


# Phase 7-8: jobs, reports, streams ----------------------------------------------------------

_PIPES: dict[tuple[int, str, str], object] = {}


def _trained(spark: SparkSession, sf_dir: str, mode: str = "aggregates"):
    """Fit once per session and table: the pipeline trained on the structured blobs."""
    from quorum.plans.train import TrainConfig, train

    key = (id(spark), sf_dir, mode)
    if key not in _PIPES:
        cfg = TrainConfig(feature_mode=mode)
        _PIPES[key] = train(spark, si.blobs(spark, sf_dir), cfg)
    return _PIPES[key]


@register("scree")
def q_scree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 on the standardised readings: (component, ratio, cumulative, k_for_target)."""
    from quorum.operators.features import scree

    return round_doubles(scree(scaled(spark, si.readings(spark, sf_dir)), "scaled"))


@register("train_summary")
def q_train_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 on the blobs: internal metrics, CV and stability in one row."""
    res = _trained(spark, sf_dir)
    cv = res.cv_summary.head() if res.cv_summary is not None else None
    st = res.stability.head() if res.stability is not None else None
    im = res.internal.head()
    row = (im["silhouette"], im["davies_bouldin"], im["noise_fraction"], im["n_clusters"], im["n_points"],
           cv["mean_ari"] if cv else None, cv["std_ari"] if cv else None, st["stability_mean_ari"] if st else None,
           st["n_pairs"] if st else 0)
    return round_doubles(spark.createDataFrame([row], "silhouette double, davies_bouldin double, noise_fraction double, "
                                               "n_clusters long, n_points long, cv_mean_ari double, cv_std_ari double, "
                                               "stability_mean_ari double, n_pairs int"))


@register("quality_flags")
def q_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.plans.report import quality_flags

    res = _trained(spark, sf_dir)
    return quality_flags(spark, res.label_map, res.internal, res.cv_summary)


@register("report_clusters")
def q_report_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.plans.report import report_tables

    return report_tables(spark, _trained(spark, sf_dir))["cluster_detail"]


@register("score_batch")
def q_score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 with neighbours: every blobs row scored by the trained pipeline."""
    res = _trained(spark, sf_dir)
    return round_doubles(res.pipeline.score(si.blobs(spark, sf_dir), with_neighbors=True))


@register("score_payloads")
def q_score_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + A8 + B8: blobs rows batched 8 per request as JSON-shaped payloads; rejected
    requests are set aside (anti-join), the rest scored with clipped confidence/novelty."""
    from quorum.operators.validate import payload_rejects
    from quorum.plans.train import score_payloads

    res = _trained(spark, sf_dir)
    b = si.blobs(spark, sf_dir)
    payloads = (b.select((F.col("row_index") / F.lit(8)).cast("long").alias("request_id"), F.struct("row_index", "sensors").alias("r"))
                .groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["sensors"]).alias("rows")))
    ok = payloads.join(payload_rejects(payloads, width=si.N_SENSORS).select("request_id"), "request_id", "left_anti")
    return round_doubles(score_payloads(res.pipeline, ok))


@register("stream_score")
def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: embeddings streamed as files -> blobs readings -> scored -> parquet sink."""
    from quorum.streaming.score_stream import embeddings_stream, score_stream

    src = si.blobs_from(embeddings_stream(spark, sf_dir)).drop("label")
    query, ok, _ = score_stream(spark, _trained(spark, sf_dir).pipeline, src)
    query.awaitTermination()
    return round_doubles(spark.read.parquet(ok).drop("batch_id"))


@register("stream_rejects", f"""
    WITH r AS (SELECT vec_id AS row_index, list_value({", ".join(f"{si.AMPLIFY} * CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(si.N_SENSORS))}) AS v
               FROM embeddings),
    e AS (SELECT row_index, unnest(v) AS x FROM r)
    SELECT row_index, 'out_of_band' AS reject_reason FROM e GROUP BY row_index
    HAVING bool_or(NOT (x BETWEEN -1.05 AND 1.05)) AND NOT bool_or(isnan(x) OR isinf(x))""")
def q_stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the same stream at 2.5x scale; rows leaving the payload band go to the reject sink."""
    from quorum.streaming.score_stream import committed, divide_stream, embeddings_stream

    src = embeddings_stream(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(si.AMPLIFY)))
    query, sinks = divide_stream(spark, si.readings_from(src).drop("label"), si.N_SENSORS, lambda good: good.select("row_index"))
    query.awaitTermination()
    return committed(spark, sinks, rejected=True).drop("batch_id")


# Phase 9-10: feature views and comparison models ------------------------------------------

_WIDE_SQL = f"""
    WITH z AS ({_scaled_long_sql(si.readings_sql())}),
    m AS (SELECT row_index, i, z, avg(z) OVER (PARTITION BY row_index) AS mu FROM z)
    SELECT row_index, list_transform(list_concat(list(z ORDER BY i), [
        avg(z), stddev_pop(z), min(z), max(z), max(z) - min(z),
        CASE WHEN avg((z-mu)*(z-mu)) > 0 THEN avg((z-mu)*(z-mu)*(z-mu)) / pow(avg((z-mu)*(z-mu)), 1.5) END,
        CASE WHEN avg((z-mu)*(z-mu)) > 0 THEN avg((z-mu)*(z-mu)*(z-mu)*(z-mu)) / pow(avg((z-mu)*(z-mu)), 2) - 3 END,
        quantile_cont(z, 0.25), quantile_cont(z, 0.75), quantile_cont(z, 0.75) - quantile_cont(z, 0.25),
        quantile_cont(z, 0.5), avg(abs(z))]), lambda v: round(v, 6) + 0.0) AS features
    FROM m GROUP BY row_index"""


@register("wide_aggregates", _WIDE_SQL)
def q_wide_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: standardised values followed by twelve per-row statistics."""
    from quorum.functions.rowstats import WIDE_FEATURE_NAMES, with_row_stats

    s = scaled(spark, si.readings(spark, sf_dir))
    return round_doubles(with_row_stats(s, "scaled", si.N_SENSORS, "features", WIDE_FEATURE_NAMES).select("row_index", "features"))


def _poly_sql() -> str:
    from quorum.operators.transforms import poly2_terms

    terms = ", ".join(f"sensors[{t[0] + 1}]" if len(t) == 1 else f"sensors[{t[0] + 1}] * sensors[{t[1] + 1}]"
                      for t in poly2_terms(si.N_SENSORS))
    return f"SELECT row_index, list_transform(list_value({terms}), lambda v: round(v, 6) + 0.0) AS features FROM ({si.readings_sql()})"


@register("poly_features", _poly_sql())
def q_poly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree-2 expansion of the readings (230 values per row)."""
    from quorum.operators.transforms import poly2

    r = si.readings(spark, sf_dir)
    return round_doubles(r.select("row_index", poly2(F.col("sensors"), si.N_SENSORS).alias("features")))


@register("rule_ensemble", f"""
    WITH {_NB_CTE},
    kv AS (SELECT row_index, nbr_class, count(*) AS votes FROM rk WHERE rank <= 5 GROUP BY row_index, nbr_class),
    kp AS (SELECT row_index, arg_max(nbr_class, votes * 1000 - nbr_class) AS knn_class FROM kv GROUP BY row_index),
    c AS ({_LC_SQL}),
    cv AS (SELECT cluster_id, label, count(*) AS n FROM c WHERE label IS NOT NULL GROUP BY cluster_id, label),
    cw AS (SELECT cluster_id, arg_max(label, n * 1000 - label) AS voted FROM cv GROUP BY cluster_id)
    SELECT c.row_index, CASE WHEN c.cluster_id = -1 THEN kp.knn_class
                             WHEN cw.voted IS NULL THEN 9999.0 ELSE cw.voted END AS predicted
    FROM c LEFT JOIN cw USING (cluster_id) LEFT JOIN kp USING (row_index)""")
def q_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise -> kNN class; unlabelled cluster -> 9999; else the cluster's majority class."""
    from quorum.operators.labelmap import class_to_cluster_vote
    from quorum.operators.neighbors import knn_classify

    b = _features(si.blobs(spark, sf_dir))
    c = _label_clusters(spark, sf_dir)
    kp = knn_classify(b, b, 5).withColumnRenamed("predicted", "knn_class")
    votes = class_to_cluster_vote(c)
    j = c.join(votes, "cluster_id", "left").join(kp, "row_index", "left")
    pred = (F.when(F.col("cluster_id") == -1, F.col("knn_class"))
            .when(F.col("voted_class").isNull(), F.lit(9999.0)).otherwise(F.col("voted_class")))
    return j.select("row_index", pred.alias("predicted"))


def _scaled_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = si.blobs(spark, sf_dir)
    return Preprocessor().fit(b).transform(b).select("row_index", "label", F.col("scaled").alias("features"))


@register("knn_features")
def q_knn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised blobs with weighted kNN class probabilities appended (k=3, weight 3)."""
    from quorum.operators.transforms import knn_proba_features

    return round_doubles(knn_proba_features(_scaled_blobs(spark, sf_dir), 3, 3.0).select("row_index", "features"))


@register("knn_feature_sweep")
def q_knn_feature_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13 + I21: density clustering after appending kNN class probabilities, k in {1, 3, 5} and weight in {1, 3, 10}."""
    from functools import reduce

    from quorum.operators.density import fit_groups, labels_of
    from quorum.operators.fit_scores import score_fits
    from quorum.operators.transforms import knn_proba_features
    from quorum.session import stored

    f = stored(_scaled_blobs(spark, sf_dir), "features")
    settings = [(i * 3 + j, k, w) for i, k in enumerate((1, 3, 5)) for j, w in enumerate((1.0, 3.0, 10.0))]
    views = stored(reduce(DataFrame.unionByName, [knn_proba_features(f, k, w).select(
        F.lit(g).cast("long").alias("grp"), F.col("row_index").cast("long").alias("row_index"), "label", "features") for g, k, w in settings]), "views")
    items, _ = fit_groups(views.select("grp", F.col("row_index").alias("id"), F.col("features").alias("vec")), 8, 3)
    names = spark.createDataFrame(settings, "grp long, k int, weight double")
    return round_doubles(score_fits(labels_of(items), views).join(F.broadcast(names), "grp").drop("grp"))


_QUANTILE_SQL = f"""
    WITH long AS ({_long_sql(si.readings_sql())}),
    s AS (SELECT i, list(x ORDER BY x) AS s, count(*) AS n, least(1000, count(*)) AS nq FROM long GROUP BY i),
    h AS (SELECT i, s, nq, unnest(generate_series(0, nq - 1)) AS k, (n - 1) * unnest(generate_series(0, nq - 1)) / CAST(nq - 1 AS DOUBLE) AS h FROM s),
    q AS (SELECT i, any_value(nq) AS nq, list(s[CAST(floor(h) AS BIGINT) + 1] + (h - floor(h)) * (s[CAST(ceil(h) AS BIGINT) + 1] - s[CAST(floor(h) AS BIGINT) + 1]) ORDER BY k) AS q
          FROM h GROUP BY i),
    p AS (SELECT l.row_index, l.i, l.x, q.q, q.nq, len(list_filter(q.q, lambda v: v <= l.x)) AS a, len(list_filter(q.q, lambda v: v < l.x)) AS b FROM long l JOIN q USING (i)),
    r AS (SELECT row_index, i, CASE WHEN x <= q[1] THEN 0 WHEN x >= q[nq] THEN 1 WHEN a > b THEN (a - 1 + b) / 2.0 / (nq - 1)
                                    ELSE (a - 1 + (x - q[a]) / (q[a + 1] - q[a])) / (nq - 1) END AS z FROM p)
    SELECT row_index, list({sql_r6('z')} ORDER BY i) AS features FROM r GROUP BY row_index"""


@register("quantile_features", _QUANTILE_SQL)
def q_quantile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 on the readings."""
    from quorum.operators.transforms import QuantileRank

    r = si.readings(spark, sf_dir).withColumnRenamed("sensors", "features")
    return round_doubles(QuantileRank().fit(r).transform(r).select("row_index", "features"))


@register("rbf_features")
def q_rbf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 on the standardised blobs (D = 200, gamma 0.1)."""
    from quorum.operators.transforms import RandomFourier

    b = _scaled_blobs(spark, sf_dir)
    return round_doubles(RandomFourier(0.1).fit(b).transform(b).select("row_index", "features"))


@register("dbscan_labels")
def q_dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I15 on the blobs (eps 0.5, min_samples 5)."""
    from quorum.operators.models import dbscan

    return dbscan(_features(si.blobs(spark, sf_dir)), 0.5, 5)


@register("label_spreading")
def q_label_spreading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16 full transduction on the standardised blobs (15-NN kernel, alpha 0.2)."""
    from quorum.operators.models import label_spreading

    return label_spreading(_scaled_blobs(spark, sf_dir))


@register("label_spreading_loo")
def q_label_spreading_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16 leave-one-out on the standardised blobs: accuracy and ARI over labelled rows."""
    from quorum.operators.metrics import accuracy, ari_value
    from quorum.operators.models import label_spreading_loo

    p = label_spreading_loo(_scaled_blobs(spark, sf_dir)).persist()
    acc = accuracy(p, "predicted", "label").head()
    out = spark.createDataFrame([(acc["accuracy"], acc["majority_accuracy"], ari_value(p, "predicted", "label"), int(acc["n"]))],
                                "accuracy double, majority_accuracy double, ari double, n long")
    return round_doubles(out)


@register("isolation_forest")
def q_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 trees of 256 rows on the standardised blobs."""
    from quorum.operators.models import isolation_forest

    return round_doubles(isolation_forest(_scaled_blobs(spark, sf_dir)))


@register("iforest_glosh_corr")
def q_iforest_glosh_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of isolation-forest scores and training GLOSH scores."""
    from quorum.operators.density import DensityModel
    from quorum.operators.models import isolation_forest

    f = _scaled_blobs(spark, sf_dir)
    g = DensityModel(min_cluster_size=8, min_samples=3).fit(f).labels
    j = isolation_forest(f).join(g, "row_index")
    return round_doubles(j.agg(F.corr("iforest_score", "outlier_score").alias("rho"), F.count(F.lit(1)).alias("n")))


@register("algorithm_comparison")
def q_algorithm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 on the standardised blobs: k-means, mixtures, Ward, spectral, DBSCAN and density over their whole grids."""
    from quorum.operators import models
    from quorum.operators.agglomerate import ward
    from quorum.operators.spectral import spectral
    from quorum.session import stored

    f = stored(_scaled_blobs(spark, sf_dir), "features")
    by_eps = lambda sweep: {f"dbscan_eps{e}": sweep.where(F.col("eps") == e) for e in EPS}
    mixture = lambda k: {f"gmm_k{k}": models.gaussian_mixture(f, k)}
    named = lambda kind, labels: {f"{kind}_k{k}": lab for k, lab in labels.items()}
    families = [  # each a chain of small jobs: beside each other they fill the cores
        lambda: named("kmeans", models.kmeans_sweep(f, (2, 3, 4, 5, 8, 10))),
        *[lambda k=k: mixture(k) for k in (2, 3, 5, 8)],
        lambda: named("ward", ward(f, (3, 5, 8))),
        lambda: named("spectral", spectral(f, (3, 5, 8))),
        lambda: by_eps(stored(models.dbscan_sweep(f, EPS), "dbscan")),
        lambda: models.density_grid(f, [5, 8, 15, 30], [3, 5])]
    with ThreadPoolExecutor(4) as beside:
        started = [beside.submit(family) for family in families]
        fits = {name: lab for family in started for name, lab in family.result().items()}
    return round_doubles(models.compare(f, fits))


#: The radii of the DBSCAN sweep.
EPS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)


@register("ward_labels")
def q_ward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I18 on the blobs: (k, row_index, cluster_id) for 3, 5 and 8 clusters of one tree."""
    from quorum.operators.agglomerate import ward
    from quorum.session import stored

    f = stored(_features(si.blobs(spark, sf_dir)).select("row_index", "features"), "features")
    parts = [lab.select(F.lit(k).alias("k"), "row_index", "cluster_id") for k, lab in ward(f, (3, 5, 8)).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("spectral_embedding")
def q_spectral_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I17 on the standardised blobs: the eight leading eigenvalues of the 15-NN graph's normalised affinity."""
    from quorum.operators.spectral import spectral_embedding
    from quorum.session import stored

    _, values, _ = spectral_embedding(stored(_scaled_blobs(spark, sf_dir), "features"), 8)
    return round_doubles(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "component int, eigenvalue double"))


@register("dbscan_sweep")
def q_dbscan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I15 + H6 on the blobs: labels at six radii from one spanning tree."""
    from quorum.operators.models import dbscan_sweep

    return dbscan_sweep(_features(si.blobs(spark, sf_dir)), EPS)


@register("density_grid")
def q_density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 + F8: the density grid (7 sizes x 3 min_samples) on the standardised blobs, scored, the best below 80 % noise marked."""
    from quorum.operators import models
    from quorum.session import stored

    f = stored(_scaled_blobs(spark, sf_dir), "features")
    table = stored(models.compare(f, models.density_grid(f, [3, 5, 8, 10, 15, 20, 30], [1, 3, 5])), "scores")
    best = models.best_constrained(table).select("name", F.lit(True).alias("is_best"))
    return round_doubles(table.join(F.broadcast(best), "name", "left").withColumn("is_best", F.coalesce("is_best", F.lit(False))))


@register("pca_sweep")
def q_pca_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 on the standardised readings: every size of PCA_SIZES."""
    from quorum.operators.transforms import pca_sweep

    s = scaled(spark, si.readings(spark, sf_dir))
    return round_doubles(pca_sweep(s, PCA_SIZES, min_cluster_size=8, min_samples=3))


#: Component counts of the sweep.
PCA_SIZES = (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 17, 19)


@register("feature_comparison")
def q_feature_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 on the standardised blobs: density scores and kNN-LOO accuracy per feature view."""
    from quorum.operators.transforms import compare_features

    b = si.blobs(spark, sf_dir)
    s = Preprocessor().fit(b).transform(b)
    return round_doubles(compare_features(s))


@register("within_between_distance", f"""
    WITH b AS ({si.blobs_sql()}), l AS (SELECT * FROM b WHERE label IS NOT NULL),
    d AS (SELECT q.label AS class, q.label = r.label AS same, list_distance(q.sensors, r.sensors) AS dist
          FROM l q, l r WHERE q.row_index <> r.row_index)
    SELECT class, {sql_r6('quantile_cont(CASE WHEN same THEN dist END, 0.5)')} AS within_median,
           {sql_r6('quantile_cont(CASE WHEN NOT same THEN dist END, 0.5)')} AS between_median,
           count_if(same) AS n_within, count_if(NOT same) AS n_between
    FROM d GROUP BY class""")
def q_within_between_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 on the blobs' labelled rows: median within- and between-class distance per class."""
    from quorum.operators.pairdist import within_between

    return round_doubles(within_between(_features(si.blobs(spark, sf_dir))))


@register("bayes_gmm")
def q_bayes_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variational Dirichlet-process mixtures (10 components, priors 1e-3 and 1e-1) scored (H7)."""
    from quorum.operators import models
    from quorum.session import stored

    f = stored(_scaled_blobs(spark, sf_dir), "features")
    priors = (1e-3, 1e-1)
    with ThreadPoolExecutor(len(priors)) as beside:
        fits = dict(zip([f"bayes_gmm_prior_{p}" for p in priors],
                        beside.map(lambda p: models.bayesian_gaussian_mixture(f, weight_concentration_prior=p), priors), strict=True))
    return round_doubles(models.compare(f, fits))


@register("nca_density")
def q_nca_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 + I21: NCA projections (3, 5, 10 and 19 dims) learned on labelled rows, then density clustering."""
    from functools import reduce

    from quorum.operators.density import fit_groups, labels_of
    from quorum.operators.fit_scores import score_fits
    from quorum.operators.transforms import NeighborhoodComponents
    from quorum.session import stored

    f = stored(_scaled_blobs(spark, sf_dir), "features")
    settings = [(i * 3 + j, dim, mcs) for i, dim in enumerate((3, 5, 10, 19)) for j, mcs in enumerate((5, 8, 15))]
    warped = {dim: stored(NeighborhoodComponents(n_components=dim).fit(f).transform(f), f"nca-{dim}") for dim in (3, 5, 10, 19)}
    views = stored(reduce(DataFrame.unionByName, [warped[dim].select(F.lit(g).cast("long").alias("grp"), F.col("row_index").cast("long").alias("row_index"), "label", "features")
                                                  for g, dim, _ in settings]), "views")
    items, _ = fit_groups(views.select("grp", F.col("row_index").alias("id"), F.col("features").alias("vec")), {g: mcs for g, _, mcs in settings}, 3)
    names = spark.createDataFrame(settings, "grp long, nca_dim int, mcs int")
    return round_doubles(score_fits(labels_of(items), views).join(F.broadcast(names), "grp").drop("grp"))


@register("rbf_sweep")
def q_rbf_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 + F9: kNN-LOO accuracy for gamma in {0.01, 0.05, 0.1, 0.5, 1}; first best flagged."""
    from quorum.operators.transforms import rbf_sweep

    return round_doubles(rbf_sweep(_scaled_blobs(spark, sf_dir), [0.01, 0.05, 0.1, 0.5, 1.0]))


@register("cv_seeded")
def q_cv_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: 10 seeds x 5 folds of the full pipeline on the blobs, summarised."""
    from quorum.plans.train import TrainConfig, cv_seeded, seeded_summary

    cv = cv_seeded(si.blobs(spark, sf_dir), TrainConfig(), list(range(42, 52)))
    return round_doubles(seeded_summary(cv))


@register("spread_distribution")
def q_spread_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class distribution of the label-spreading transduction."""
    from quorum.operators.metrics import class_distribution
    from quorum.operators.models import label_spreading

    return class_distribution(label_spreading(_scaled_blobs(spark, sf_dir)))


FLAGSHIP = "density_scores"

from quorum.plans import contested  # noqa: E402,F401  (registers its queries in the same tables)
