import pytest

from matchloom.session import local_session, prepare


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(8, "tests"))
    yield session
    session.stop()
