import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from riskspark.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()
