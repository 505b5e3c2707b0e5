import os
import sys

import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from papyra.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
