import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from contentflow.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def testdata():
    return TESTDATA


@pytest.fixture
def one(spark):
    """Value of an expression over a one-row frame: ``one(fn, value, type)``."""

    def run(fn, value, dtype="string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(value,)], f"x {dtype}").select(fn(F.col("x")).alias("y")).first()["y"]

    return run
