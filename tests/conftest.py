import pytest

from flowlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
