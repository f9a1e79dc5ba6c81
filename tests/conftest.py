import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import drop_stages, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "tests", str(tmp_path_factory.mktemp("shared")))
    yield session
    drop_stages(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame(rows, schema)``."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
