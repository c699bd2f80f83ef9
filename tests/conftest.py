import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vellum.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session(master="local[*]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vellum-test-ckpt-", dir="/tmp")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """The reference's own 5-row fixture."""
    import datetime as dt
    rows = [(1.0, "apple", 10.1, dt.datetime(2023, 1, 1)), (2.0, "banana", 20.2, dt.datetime(2023, 1, 2)),
            (3.0, "apple", 10.1, dt.datetime(2023, 1, 3)), (4.0, "orange", 30.3, dt.datetime(2023, 1, 4)),
            (None, "banana", 20.2, dt.datetime(2023, 1, 5))]
    return spark.createDataFrame(rows, "col_a double, col_b string, col_c double, col_d timestamp_ntz")
