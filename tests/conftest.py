import os

import pytest

from oratorio.session import session

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", **{"spark.driver.memory": "4g"})
    yield s


@pytest.fixture(scope="session")
def sf():
    return SMALL if os.path.isdir(SMALL) else pytest.skip("no test tables")
