import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from advigil.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="advigil-test-")


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression over one row of named values."""

    def run(expression, schema="x int", row=(1,)):
        return spark.createDataFrame([row], schema).select(expression.alias("v")).first().v

    return run
