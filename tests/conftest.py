import pytest

from rulewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
