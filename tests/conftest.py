import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from sparkcurate.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
