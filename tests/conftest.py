import pytest

from corpusloom.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(master="local[4]", partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
