"""Values at the edges: null in a payload, one-row and huge groups, coinciding points, small trees, bucket borders."""

from pyspark.sql import functions as F

from quorum.operators.metrics import _c2, ari, silhouette
from quorum.operators.models import _c_factor
from quorum.operators.splits import md5_key, stratified_rank
from quorum.operators.validate import vector_reject_reason
from quorum.plans.train import grouped_ari


def test_null_element_is_rejected(spark):
    df = spark.createDataFrame([([0.1, None],), ([0.1, 0.2],)], "v array<double>")
    assert [r[0] for r in df.select(vector_reject_reason(F.col("v"))).collect()] == ["non_finite", None]


def test_ari_of_one_row_and_of_huge_groups(spark):
    one = spark.createDataFrame([("g", 1, 2)], "k string, a int, b int")
    assert ari(one, "a", "b").first()["ari"] == 1.0
    assert grouped_ari(one, ["k"], "a", "b").first()["ari"] == 1.0
    assert spark.range(1).select(_c2(F.lit(1 << 40))).first()[0] > 1e23


def test_silhouette_of_coinciding_points_is_zero(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0], i % 2) for i in range(6)], "row_index long, features array<double>, cluster_id int")
    assert silhouette(df) == 0.0


def test_average_path_of_two_rows():
    assert _c_factor(2) == 1.0


def test_rank_is_the_same_on_both_sides_of_the_group_bound(spark):
    df = spark.range(60).select(F.col("id").alias("row_index"), F.lit(1).alias("s"))
    a, b = ({r["row_index"]: r["stratum_rank"] for r in stratified_rank(df, "s", md5_key("row_index"), max_group_rows=m).collect()} for m in (10, 1000))
    assert a == b
