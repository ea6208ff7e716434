"""Cluster naming by weighted vote of labelled members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.functions.names import NOISE_NAME, class_name, is_unknown, name_to_code, unknown_name

LABEL_MAP_SCHEMA_VERSION = "1.0.0"
LABEL_MAP_COLUMNS = ["cluster_id", "name", "is_known", "is_noise", "purity", "n_labeled", "n_total", "label_distribution"]


def build_label_map(df: DataFrame, *, cluster: str = "cluster_id", label: str = "label", weighted: bool = True) -> DataFrame:
    """One row per cluster id present in ``df``.

    * class weights 1 / class_count (E3) so rare classes are not crowded out;
    * the vote score of class c in cluster k is n(k, c) / count(c) — one division,
      so equal ratios compare equal; ties go to the smaller class (E5, F2);
    * purity = largest raw class count / labelled count (E6) — of the largest
      class, which need not be the winner;
    * noise keeps its labelled counts; clusters without labels are UNKNOWN_<id>.
    """
    src = df.select(F.col(cluster).cast("int").alias("cluster_id"), F.col(label).cast("double").alias("label"))
    totals = src.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("n_total"))
    lab = src.where(F.col("label").isNotNull())
    class_counts = lab.groupBy("label").agg(F.count(F.lit(1)).alias("class_n"))
    per = lab.groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("n")).join(class_counts, "label")
    score = (F.col("n") / F.col("class_n")) if weighted else F.col("n").cast("double")
    per = per.withColumn("score", score)
    stats = per.groupBy("cluster_id").agg(
        F.max_by("label", F.struct(F.col("score"), -F.col("label"))).alias("winner"),
        (F.max("n") / F.sum("n")).alias("purity"),
        F.sum("n").cast("int").alias("n_labeled"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), F.col("n").cast("int"))))).alias("dist"),
    )
    j = totals.join(stats, "cluster_id", "left")
    noise = F.col("cluster_id") == -1
    has = F.coalesce(F.col("n_labeled"), F.lit(0)) > 0
    empty = F.create_map().cast("map<string,int>")
    return j.select(
        "cluster_id",
        F.when(noise, F.lit(NOISE_NAME)).when(~has, unknown_name(F.col("cluster_id"))).otherwise(class_name(F.col("winner"))).alias("name"),
        (~noise & has).alias("is_known"),
        noise.alias("is_noise"),
        F.when(~noise & has, F.col("purity")).alias("purity"),
        F.coalesce(F.col("n_labeled"), F.lit(0)).alias("n_labeled"),
        "n_total",
        F.when(has, F.col("dist")).otherwise(empty).alias("label_distribution"),
    )


def apply_names(pred: DataFrame, label_map: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Broadcast left join; unseen ids read as NOISE and not known.

    The label map has one row per cluster (bounded by n / min_cluster_size and, in
    practice, tiny) — it is the small side of every scoring join.
    """
    lm = label_map.select(F.col("cluster_id").alias("__cid"), F.col("name").alias("__name"), F.col("is_known").alias("__known"))
    j = pred.join(F.broadcast(lm), F.col(cluster) == F.col("__cid"), "left")
    return j.withColumn("predicted_label", F.coalesce("__name", F.lit(NOISE_NAME))).withColumn(
        "cluster_is_known", F.coalesce("__known", F.lit(False))).drop("__cid", "__name", "__known")


def low_purity_warnings(label_map: DataFrame, purity_warning: float = 0.6) -> DataFrame:
    """Known clusters with purity strictly below the threshold, with message text."""
    msg = F.format_string(f"Cluster %d (%s) has low purity %.2f < {purity_warning:.2f}", F.col("cluster_id"), F.col("name"), F.col("purity"))
    return label_map.where(F.col("is_known") & (F.col("purity") < purity_warning)).select("cluster_id", "name", "purity", msg.alias("message"))


def novel_clusters(label_map: DataFrame) -> DataFrame:
    """B14."""
    return label_map.where(~F.col("is_known") & ~F.col("is_noise"))


def cluster_counts(label_map: DataFrame) -> DataFrame:
    """Known / unknown / noise cluster counts."""
    return label_map.agg(
        F.count_if("is_known").alias("n_known"),
        F.count_if(~F.col("is_known") & ~F.col("is_noise")).alias("n_unknown"),
        F.count_if("is_noise").alias("n_noise"),
    )


def cluster_listing(label_map: DataFrame) -> DataFrame:
    """ordered by cluster id (ordering is applied by the consumer; NaN purity is NULL already)."""
    return label_map.orderBy("cluster_id")


def report_order(label_map: DataFrame) -> DataFrame:
    """noise last, then larger clusters first (cluster id for stability)."""
    return label_map.orderBy(F.col("is_noise").asc(), F.col("n_total").desc(), F.col("cluster_id").asc())


def encode_names(df: DataFrame, name: str = "predicted_label") -> DataFrame:
    """J2 column: name -> integer code used for ARI on held-out folds."""
    return df.withColumn("label_code", name_to_code(F.col(name)))


def batch_counts(pred: DataFrame) -> DataFrame:
    """Rows, novel rows, rows in UNKNOWN clusters."""
    return pred.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_novel").alias("n_novel"),
        F.count_if(is_unknown(F.col("predicted_label"))).alias("n_unknown"),
    )


def class_to_cluster_vote(df: DataFrame, cluster: str = "cluster_id", label: str = "label") -> DataFrame:
    """D10 helper: unweighted majority class per cluster (smallest class on ties)."""
    per = df.where(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(cluster).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("voted_class"))


def apply_vote(pred: DataFrame, votes: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Left join of the cluster -> class vote, default -1."""
    return pred.join(votes, cluster, "left").withColumn("voted_class", F.coalesce(F.col("voted_class"), F.lit(-1.0)))
