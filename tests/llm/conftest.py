import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return FOLDER


@pytest.fixture(scope="session")
def shipped(spark):
    from clustercat.shipping import ship

    ship(spark)
    return spark
