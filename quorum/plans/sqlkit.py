"""Shared helpers for query plans and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def r6(c: Column) -> Column:
    """Round to 6 decimals; ``+ 0.0`` turns -0.0 into 0.0 so both engines hash alike."""
    return F.round(c, DIGITS) + F.lit(0.0)


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every DOUBLE (and ARRAY<DOUBLE>) column for engine-independent comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = r6(c.cast("double"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: r6(x.cast("double")))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql_r6(expr: str) -> str:
    return f"(round(({expr}), {DIGITS}) + 0.0)"
