import pytest

from tollhouse.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cpus=4, memory="4g", name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
