import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from eventloom.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "10000",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows(spark):
    """Rows of a DataFrame as sorted tuples in column order."""
    def collect(df):
        return sorted(tuple(r) for r in df.collect())
    return collect
