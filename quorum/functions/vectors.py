"""Array (vector) column helpers.

Readings travel as ``ARRAY<DOUBLE>``; these helpers build array functions on
them, so a plan never grows with the width of the table.  Products with a dense
matrix are numpy products of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double_array(col: Column | str, width: int | None = None) -> Column:
    """Cast every element to DOUBLE (float32 input drifts otherwise)."""
    c = F.col(col) if isinstance(col, str) else col
    if width is not None:
        c = F.slice(c, 1, width)
    return F.transform(c, lambda x: x.cast("double"))


def wide_to_array(cols: Sequence[str]) -> Column:
    """Wide layout (one column per sensor) -> ``ARRAY<DOUBLE>`` in the given order."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def array_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def sq_euclidean(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two equal-length arrays."""
    return F.sqrt(sq_euclidean(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def affine(c: Column, shift: Sequence[float], scale: Sequence[float]) -> Column:
    """``(x[i] - shift[i]) / scale[i]`` with broadcast literal vectors."""
    sh = F.array(*[F.lit(float(v)) for v in shift])
    sc = F.array(*[F.lit(float(v)) for v in scale])
    return F.transform(c, lambda x, i: (x - F.element_at(sh, i + 1)) / F.element_at(sc, i + 1))


def matvec(c: Column, rows: Sequence[Sequence[float]], center: Sequence[float] | None = None) -> Column:
    """Project ``c`` onto each row of a small dense matrix (k x d): returns k values.

    The matrix is a model parameter (bounded by the width of the table); it travels with the
    function, and each Arrow batch is one matrix product.
    """
    m = np.asarray(rows, dtype=float)
    shift = np.zeros(m.shape[1]) if center is None else np.asarray(center, dtype=float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(batch.to_numpy()).astype(float) - shift) @ m.T))

    return project(c)


def round_array(c: Column, digits: int = 6) -> Column:
    return F.transform(c, lambda x: F.round(x, digits))
