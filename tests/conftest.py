import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))


@pytest.fixture(scope="session")
def spark():
    from curvemill.session import local_session
    s = local_session("4", memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
