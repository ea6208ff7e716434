"""Data profile operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.operators.features import column_stats, gram, vector_width


def label_histogram(df: DataFrame, label: str = "label", *, dropna: bool = True) -> DataFrame:
    """(label, n); NULL labels kept as their own group when ``dropna`` is False."""
    src = df.where(F.col(label).isNotNull()) if dropna else df
    return src.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One aggregate pass, then unpivot to (column, n_null)."""
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_null"))
                                          for i, c in enumerate(columns)])).alias("s")).select("s.column", "s.n_null")


def corr_matrix(df: DataFrame, col: str = "sensors") -> DataFrame:
    """Pearson correlation of every dimension pair (i < j), over the rows that have both values.

    One Gram pass around the column means: each partition multiplies its rows into
    d x d matrices, and d (d - 1) / 2 rows come out; NULL where a column doesn't vary.
    """
    d = vector_width(df, col)
    means = [m or 0.0 for m in column_stats(df, col, d)["mean"]]
    g = gram(df, col, d, means)
    rows = []
    for i in range(d):
        for j in range(i + 1, d):
            n = g["n"][i, j]
            var_i, var_j = (n * g["q"][a, b] - g["s"][a, b] ** 2 for a, b in ((i, j), (j, i)))
            both = var_i * var_j
            rows.append((i, j, float((n * g["p"][i, j] - g["s"][i, j] * g["s"][j, i]) / np.sqrt(both)) if both > 0 else None))
    return df.sparkSession.createDataFrame(rows, "i int, j int, corr double")


def corr_summary(corr: DataFrame) -> DataFrame:
    """Mean and max |off-diagonal| correlation."""
    return corr.agg(F.avg(F.abs("corr")).alias("mean_abs_corr"), F.max(F.abs("corr")).alias("max_abs_corr"))


def sensor_histogram(df: DataFrame, col: str = "sensors", bins: int = 40) -> DataFrame:
    """Equal-width bins between each dimension's min and max; max lands in the last bin."""
    from quorum.operators.features import _long_stats

    d = vector_width(df, col)
    st = _long_stats(df, col, d)
    lo = F.array(*[F.lit(st[i]["lo"]) for i in range(d)])
    hi = F.array(*[F.lit(st[i]["hi"]) for i in range(d)])
    long_df = df.select(F.posexplode(col).alias("sensor", "x"))
    a, b = F.element_at(lo, F.col("sensor") + 1), F.element_at(hi, F.col("sensor") + 1)
    bin_ = F.when(b > a, F.least(F.floor((F.col("x") - a) / (b - a) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return long_df.groupBy(F.col("sensor"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, col: str = "sensors", label: str = "label") -> dict[str, DataFrame]:
    """M9: shape, nulls, label counts, histograms, correlation and scree tables."""
    from quorum.operators.features import Preprocessor, scree

    d = vector_width(df, col)
    shape = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_sensors", F.lit(d))
    nulls = df.select(F.posexplode(col).alias("sensor", "x")).groupBy("sensor").agg(
        F.count_if(F.col("x").isNull() | F.isnan("x")).alias("n_null"))
    corr = corr_matrix(df, col)
    scaled = Preprocessor().fit(df, col).transform(df, col)
    return {
        "shape": shape,
        "nulls": nulls,
        "labels": label_histogram(df, label, dropna=False),
        "histogram": sensor_histogram(df, col),
        "correlation": corr,
        "correlation_summary": corr_summary(corr),
        "scree": scree(scaled, "scaled"),
    }
