import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    import oracle

    session = oracle.session()
    # On tables this small, compiling a plan costs more than interpreting it.
    session.conf.set("spark.sql.codegen.wholeStage", False)
    session.conf.set("spark.sql.shuffle.partitions", 4)
    return session
