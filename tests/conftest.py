import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fieldmodes.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, app_name="fieldmodes-tests")
    yield s
    s.stop()


@pytest.fixture
def mk(spark):
    """Build a row matrix DataFrame from a NumPy array (rows get ids 0..n-1)."""
    def make(a, parts=None, ids=None):
        a = np.asarray(a, dtype=float)
        ids = list(range(a.shape[0])) if ids is None else ids
        df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, a)],
                                   "row_id bigint, vector array<double>")
        return df.repartition(parts) if parts else df
    return make


def to_np(df, col="vector"):
    return np.array([r[col] for r in df.orderBy("row_id").collect()])
