"""quorum — semi-supervised density clustering of wide reading tables on Spark.

Every operator takes and returns DataFrames.  Rows carry an explicit
``row_index`` (BIGINT) key; readings travel as ``sensors ARRAY<DOUBLE>`` and
derived features as ``features ARRAY<DOUBLE>``.  Labels are nullable DOUBLE.
"""

import os

# driver-side linear algebra is tiny (width x width); a threaded BLAS next to the JVM has deadlocked
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from quorum.session import checkpoint_dir, get_spark  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]
