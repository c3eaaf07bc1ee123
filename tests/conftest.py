import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import tools_check
    s = tools_check.session()
    s.sparkContext.setLogLevel("ERROR")
    return s
