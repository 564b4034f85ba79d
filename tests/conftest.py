import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foliolens.session import build_session  # noqa: E402

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "foliolens-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a Column function to rows of literal arguments and return the results."""

    def run(build, rows, schema):
        frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
        result = frame.select("i", build(*[frame[c] for c in frame.columns[1:]]).alias("out"))
        return [row["out"] for row in sorted(result.collect(), key=lambda row: row["i"])]

    return run
