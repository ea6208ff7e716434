import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # a threaded LAPACK call deadlocked next to the JVM once

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quorum.session import checkpoint_dir, get_spark

    from quorum.session import ship_package

    s = get_spark("local[4]")
    checkpoint_dir(s)
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def blob_points():
    """Three tight 20-d blobs of 60 rows + 20 uniform background rows, 4 labels per blob."""
    rng = np.random.default_rng(42)
    centres = rng.uniform(-0.5, 0.5, size=(3, 20))
    pts, truth = [], []
    for b in range(3):
        pts.append(centres[b] + rng.normal(0, 0.05, size=(60, 20)))
        truth += [b] * 60
    pts.append(rng.uniform(-0.95, 0.95, size=(20, 20)))
    truth += [-1] * 20
    x = np.clip(np.vstack(pts), -0.999, 0.999)
    truth = np.array(truth)
    label = np.full(len(x), np.nan)
    for b in range(3):
        idx = rng.choice(np.nonzero(truth == b)[0], 4, replace=False)
        label[idx] = b + 1.0
    return x, label, truth


@pytest.fixture(scope="session")
def blobs_df(spark, blob_points):
    x, label, _ = blob_points
    rows = [(i, [float(v) for v in x[i]], None if np.isnan(label[i]) else float(label[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "row_index long, sensors array<double>, label double")
