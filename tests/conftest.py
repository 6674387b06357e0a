import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexmill.session import local_session, release_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=8)
    yield session
    release_scratch(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows(data, schema)`` as a DataFrame."""
    return lambda data, schema: spark.createDataFrame(data, schema)
