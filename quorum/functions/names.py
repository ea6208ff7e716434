"""Scalar naming / formatting functions (J1-J12) as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name shapes and codes of the cluster naming scheme.
NOISE_NAME = "NOISE"
CLASS_PREFIX = "CLASS_"
UNKNOWN_PREFIX = "UNKNOWN_"
UNKNOWN_OFFSET = 1000
NOISE_CODE = -1
MISSING_CODE = -999


def class_name(label: Column) -> Column:
    """1.0 -> 'CLASS_1'."""
    return F.concat(F.lit(CLASS_PREFIX), label.cast("int").cast("string"))


def unknown_name(cluster_id: Column) -> Column:
    return F.concat(F.lit(UNKNOWN_PREFIX), cluster_id.cast("string"))


def name_to_code(name: Column) -> Column:
    """NOISE -> -1, CLASS_n -> n, UNKNOWN_k -> 1000 + k, anything else raises."""
    cls = F.regexp_extract(name, r"^CLASS_(\d+)$", 1)
    unk = F.regexp_extract(name, r"^UNKNOWN_(\d+)$", 1)
    return (
        F.when(name == F.lit(NOISE_NAME), F.lit(NOISE_CODE))
        .when(cls != "", cls.cast("int"))
        .when(unk != "", unk.cast("int") + F.lit(UNKNOWN_OFFSET))
        .otherwise(F.raise_error(F.concat(F.lit("Unrecognized cluster label name: "), F.coalesce(name, F.lit("NULL")))).cast("int"))
    )


def is_unknown(name: Column) -> Column:
    """J3."""
    return name.startswith(UNKNOWN_PREFIX)


def fmt_number(x: Column, digits: int = 3) -> Column:
    """Fixed-point text, 'n/a' for NULL or NaN."""
    return F.when(x.isNull() | F.isnan(x), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", x))


def clip01(x: Column) -> Column:
    """Clip into [0, 1]; NaN counts as largest, so it becomes 1.0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def nan_to_null(x: Column) -> Column:
    """J6."""
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def fill_code(x: Column) -> Column:
    """Fill-null then cast to int."""
    return F.coalesce(x.cast("int"), F.lit(MISSING_CODE))


def map_text(m: Column) -> Column:
    """J10: 'k: v, ...' or '-' for an empty map."""
    txt = F.array_join(
        F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))),
        ", ",
    )
    return F.when(F.size(m) > 0, txt).otherwise(F.lit("-"))


def utc_now_iso() -> Column:
    """UTC ISO-8601 timestamp text."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
