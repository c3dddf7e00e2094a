import pytest

from quillon.session import session
from quillon.storage import clear


@pytest.fixture(scope="session")
def spark():
    s = session(4, "4g", 4)
    yield s
    clear(s)
    s.stop()
