import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from corpusmill.session import build_session, ship_package

    s = build_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
