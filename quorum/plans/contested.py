"""Queries on data where rules compete: mixed clusters, missing values, every reject reason, sinks read back.

They register in the catalog's tables, with the SQL that DuckDB runs on the same input.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.plans.catalog import _trained, label_map_sql, register
from quorum.plans.sqlkit import round_doubles, sql_r6
from quorum.sources import stand_ins as si

_MIXED = si.mixed_clusters_sql()
_MAP = label_map_sql(_MIXED)


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.labelmap import build_label_map

    return build_label_map(si.mixed_clusters(spark, sf_dir))


# Votes ------------------------------------------------------------------------------------

@register("label_map_contested", _MAP)
def q_label_map_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of several classes, so weights and ties decide names."""
    from quorum.functions.names import map_text

    lm = _map(spark, sf_dir)
    return round_doubles(lm.select(*[c for c in lm.columns if c != "label_distribution"], map_text(F.col("label_distribution")).alias("distribution")))


@register("cluster_purity_contested", f"""
    WITH per AS (SELECT cluster_id, label, count(*) AS n FROM ({_MIXED}) WHERE label IS NOT NULL GROUP BY cluster_id, label)
    SELECT cluster_id, {sql_r6('max(n) / sum(n)')} AS purity, sum(n) AS n_labeled FROM per GROUP BY cluster_id""")
def q_cluster_purity_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 where purity isn't 1."""
    from quorum.operators.metrics import cluster_purity

    return round_doubles(cluster_purity(si.mixed_clusters(spark, sf_dir)))


@register("low_purity_contested", f"""
    SELECT cluster_id, name, purity, printf('Cluster %d (%s) has low purity %.2f < 0.80', cluster_id, name, purity) AS message
    FROM ({_MAP}) WHERE is_known AND purity < 0.8""")
def q_low_purity_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B13 with a limit of 0.8, below which there are clusters."""
    from quorum.operators.labelmap import low_purity_warnings

    return round_doubles(low_purity_warnings(_map(spark, sf_dir), 0.8))


@register("novel_clusters", f"SELECT cluster_id, name, n_total FROM ({_MAP}) WHERE NOT is_known AND NOT is_noise")
def q_novel_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters without labels that aren't noise."""
    from quorum.operators.labelmap import novel_clusters

    return novel_clusters(_map(spark, sf_dir)).select("cluster_id", "name", "n_total")


@register("cluster_listing", f"SELECT cluster_id, name, is_known, is_noise, purity, n_labeled, n_total FROM ({_MAP}) ORDER BY cluster_id")
def q_cluster_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing by cluster id."""
    from quorum.operators.labelmap import cluster_listing

    return round_doubles(cluster_listing(_map(spark, sf_dir)).drop("label_distribution"))


@register("vote_predictions", f"""
    WITH s AS ({_MIXED}),
    per AS (SELECT cluster_id, label, count(*) AS n FROM s WHERE label IS NOT NULL AND cluster_id <> 3 GROUP BY cluster_id, label),
    v AS (SELECT cluster_id, label FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, label) AS r FROM per) WHERE r = 1)
    SELECT s.row_index, s.cluster_id, coalesce(v.label, -1.0) AS voted_class FROM s LEFT JOIN v USING (cluster_id)""")
def q_vote_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority class of each cluster but one, given to all rows; -1 where a cluster has no vote."""
    from quorum.operators.labelmap import apply_vote, class_to_cluster_vote

    rows = si.mixed_clusters(spark, sf_dir)
    return apply_vote(rows.select("row_index", "cluster_id"), class_to_cluster_vote(rows.where("cluster_id <> 3")))


_NOVELTY = 0.5
_NAMED_SQL = f"""
    SELECT s.row_index, s.cluster_id, coalesce(m.name, 'NOISE') AS predicted_label, coalesce(m.is_known, false) AS cluster_is_known,
           (abs(CAST(e.embedding[1] AS DOUBLE)) >= {_NOVELTY} OR s.cluster_id = -1) AS is_novel
    FROM ({_MIXED}) s JOIN embeddings e ON e.vec_id = s.row_index LEFT JOIN (SELECT * FROM ({_MAP}) WHERE cluster_id <> 5) m ON m.cluster_id = s.cluster_id"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorum.operators.labelmap import apply_names

    novelty = si.embeddings(spark, sf_dir).select(F.col("vec_id").alias("row_index"), F.abs(F.col("embedding")[0].cast("double")).alias("novelty"))
    rows = si.mixed_clusters(spark, sf_dir).drop("label").join(novelty, "row_index")
    named = apply_names(rows, _map(spark, sf_dir).where("cluster_id <> 5"))
    return named.select("row_index", "cluster_id", "predicted_label", "cluster_is_known",
                        ((F.col("novelty") >= _NOVELTY) | (F.col("cluster_id") == -1)).alias("is_novel"))


@register("named_predictions", _NAMED_SQL)
def q_named_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by cluster, NOISE for the cluster that the map lacks."""
    return _named(spark, sf_dir)


@register("batch_counts", f"""
    SELECT count(*) AS n_rows, count_if(is_novel) AS n_novel, count_if(starts_with(predicted_label, 'UNKNOWN_')) AS n_unknown FROM ({_NAMED_SQL})""")
def q_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E20."""
    from quorum.operators.labelmap import batch_counts

    return batch_counts(_named(spark, sf_dir))


# Missing values and profile -----------------------------------------------------------------

@register("impute_missing", f"""
    WITH long AS ({si.gappy_long_sql()}), m AS (SELECT i, median(x) AS med FROM long GROUP BY i),
    f AS (SELECT row_index, i, coalesce(x, med) AS x FROM long JOIN m USING (i)),
    st AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM f GROUP BY i)
    SELECT row_index, list({sql_r6('(x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END')} ORDER BY i) AS scaled FROM f JOIN st USING (i) GROUP BY row_index""")
def q_impute_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 and C2 on readings with gaps, NULL and NaN: medians put in, then standardised."""
    from quorum.operators.features import Preprocessor

    rows = si.gappy_readings(spark, sf_dir)
    return round_doubles(Preprocessor().fit(rows).transform(rows).select("row_index", "scaled"))


@register("data_profile", f"""
    WITH r AS ({si.readings_sql()}), long AS ({si.gappy_long_sql()})
    SELECT 'shape' AS section, 'rows' AS item, count(*) AS n FROM r
    UNION ALL SELECT 'shape', 'sensors', max(len(sensors)) FROM r
    UNION ALL SELECT 'nulls', CAST(i AS VARCHAR), count(*) - count(x) FROM long GROUP BY i
    UNION ALL SELECT 'labels', coalesce(CAST(label AS VARCHAR), 'none'), count(*) FROM r GROUP BY label""")
def q_data_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 on readings with gaps: shape, missing values per sensor, label counts."""
    from quorum.operators.explore import profile

    tables = profile(si.gappy_readings(spark, sf_dir))

    def section(name: str, item: Column, n: Column, table: str) -> DataFrame:
        return tables[table].select(F.lit(name).alias("section"), item.alias("item"), n.cast("long").alias("n"))

    return reduce(DataFrame.unionByName, [
        section("shape", F.lit("rows"), F.col("n_rows"), "shape"), section("shape", F.lit("sensors"), F.col("n_sensors"), "shape"),
        section("nulls", F.col("sensor").cast("string"), F.col("n_null"), "nulls"),
        section("labels", F.coalesce(F.col("label").cast("string"), F.lit("none")), F.col("n"), "labels")])


# Payload predicate: every reason --------------------------------------------------------------

def _payload_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a row of ``readings``; the id's remainder decides what is wrong with it."""
    kind, v = F.col("row_index") % 9, F.col("sensors")
    changed = lambda value: F.transform(v, lambda x, i: F.when(i == 2, value).otherwise(x))
    row = (F.when(kind == 1, F.array().cast("array<double>")).when(kind == 2, changed(F.lit(None).cast("double")))
           .when(kind == 3, changed(F.lit(float("nan")))).when(kind == 4, changed(F.lit(float("-inf"))))
           .when(kind == 5, F.slice(v, 1, si.N_SENSORS - 1)).when(kind == 6, changed(F.lit(1.5)))
           .when(kind == 7, F.flatten(F.array_repeat(v, 17))).otherwise(v))
    rows = F.when(kind == 8, F.array().cast("array<array<double>>")).otherwise(F.array(v, row))
    return si.readings(spark, sf_dir).select(F.col("row_index").alias("request_id"), rows.alias("rows"))


@register("reject_reasons", f"""
    WITH r AS ({si.readings_sql()}), b AS (SELECT row_index, row_index % 9 AS kind, list_bool_or(list_transform(sensors, lambda x: NOT (x BETWEEN -1.05 AND 1.05))) AS off FROM r)
    SELECT row_index AS request_id,
           CASE WHEN kind = 8 THEN 'empty' WHEN off THEN 'out_of_band' WHEN kind = 1 THEN 'empty' WHEN kind IN (2, 3, 4) THEN 'non_finite'
                WHEN kind = 5 THEN 'wrong_width' WHEN kind = 6 THEN 'out_of_band' ELSE 'too_wide' END AS reason,
           CAST(CASE WHEN kind = 8 THEN NULL WHEN off THEN 0 ELSE 1 END AS BIGINT) AS bad_row
    FROM b WHERE off OR kind BETWEEN 1 AND 8""")
def q_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No rows, an empty, gappy, infinite, short, outlying or too wide second row."""
    from quorum.operators.validate import payload_rejects

    return payload_rejects(_payload_cases(spark, sf_dir), width=si.N_SENSORS)


# Columns, sinks, jobs ---------------------------------------------------------------------------

@register("aligned_readings", f"SELECT row_index, list_transform(sensors, lambda v: round(v, 6) + 0.0) AS sensors FROM ({si.readings_sql()})")
def q_aligned_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in reverse order among others, found by prefix and put in the fitted order."""
    from quorum.operators.validate import align_columns
    from quorum.sources.readers import columns_by_prefix

    wide = si.readings_wide(spark, sf_dir)
    mixed = wide.select(F.lit("x").alias("Sensor note"), *[F.col(f"`{c}`") for c in reversed(wide.columns)])
    names = columns_by_prefix(mixed)
    aligned = align_columns(mixed, ["row_index", *names])
    return round_doubles(aligned.select("row_index", F.array(*[F.col(f"`{c}`") for c in names]).alias("sensors")))


@register("sink_round_trips", f"""
    SELECT f.sink, p.row_index, p.cluster_id, p.predicted_label, p.is_novel
    FROM ({_NAMED_SQL}) p, (SELECT unnest(['parquet', 'csv', 'ndjson']) AS sink) f""")
def q_sink_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named predictions written to each sink and read back."""
    from quorum.session import checkpoint_dir, stored
    from quorum.sources.sinks import write_ndjson, write_predictions

    pred = stored(_named(spark, sf_dir).drop("cluster_is_known"), "predictions")
    base = f"{checkpoint_dir(spark)}/sinks-{uuid.uuid4().hex}"
    write_predictions(pred, f"{base}/p.parquet")
    write_predictions(pred, f"{base}/p.csv")
    write_ndjson(pred, f"{base}/p.ndjson")
    back = {"parquet": spark.read.parquet(f"{base}/p.parquet"), "csv": spark.read.schema(pred.schema).option("header", True).csv(f"{base}/p.csv"),
            "ndjson": spark.read.schema(pred.schema).json(f"{base}/p.ndjson")}
    return reduce(DataFrame.unionByName, [t.select(F.lit(sink).alias("sink"), *pred.columns) for sink, t in back.items()])


@register("score_files")
def q_score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the readings as a CSV file are loaded, validated, scored and written as Parquet."""
    from quorum.plans.train import score_files
    from quorum.session import checkpoint_dir

    base = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    b = si.blobs(spark, sf_dir)
    b.select("row_index", *[F.col("sensors")[i].alias(f"Sensor {i}") for i in range(si.N_SENSORS)], F.col("label").alias("Label")).write.option(
        "header", True).csv(f"{base}/readings.csv")
    return round_doubles(score_files(spark, _trained(spark, sf_dir).pipeline, f"{base}/readings.csv", f"{base}/scores.parquet", n_sensors=si.N_SENSORS))


@register("model_info")
def q_model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: version, clusters, unknown clusters and limits of the trained model; its time of training is left out."""
    from quorum.plans.train import bundle_info

    return bundle_info(_trained(spark, sf_dir).pipeline, spark).drop("trained_at")
