import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from millrace.session import get_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("MILLRACE_DRIVER_MEMORY", "4g")
    s = get_session("tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
