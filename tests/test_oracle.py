"""Every query that has SQL gives the same rows on both engines."""

import os

import oracle
import pytest

from clustercat.plans import driver

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(driver.ORACLE))
def test_same_as_sql(spark, con, name):
    assert oracle.difference(spark, con, FOLDER, name, driver.QUERIES[name], driver.ORACLE[name]) is None
