import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skylane.session import checkpoint_dir, local_session
    s = local_session(4, shuffle_partitions=8, app="skylane-tests")
    # tests run without a cluster: give them their own checkpoint folder
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="skylane-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def flights_small(spark):
    from skylane.plans.registry import load
    return load(spark, SF_SMALL).cache()


def rows(df, *cols):
    """Collected rows as tuples (optionally selected columns)."""
    d = df.select(*cols) if cols else df
    return [tuple(r) for r in d.collect()]


@pytest.fixture()
def flights_raw(spark):
    """Uncached flights (for plan-shape assertions). The cache manager would
    substitute an identical cached plan, so the cache is cleared first."""
    from skylane.plans.registry import load
    spark.catalog.clearCache()
    return load(spark, SF_SMALL)
