import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]


@pytest.fixture(scope="session")
def spark():
    from gazette.session import get_spark
    s = get_spark("local[2]", 4, app="gazette-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
