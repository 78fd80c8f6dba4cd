import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagemill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("pagemill-tests", "local[4]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ev(spark):
    """Evaluate one Column over one row."""
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]
