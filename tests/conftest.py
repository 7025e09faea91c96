import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[8]", 4, "8g")
    s.sparkContext.setLogLevel("ERROR")
    return s
