import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codestrata.session import build_local

    s = build_local("codestrata-tests", cpus="*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def files(spark):
    def make(rows):
        rows = [("p", p, t) for p, t in rows]
        return spark.createDataFrame(rows, "project string, path string, text string")

    return make
