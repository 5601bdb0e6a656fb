"""One local session for all tests."""

import pytest

from tracewell.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
