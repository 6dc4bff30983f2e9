import pytest

from spanloom import get_session
from spanloom.session import drop_staged


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", 2, shuffle_partitions=2)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    drop_staged(s)
