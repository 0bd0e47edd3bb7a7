import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from vectorloom.session import attach, local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.addPyFile(os.path.join(ROOT, "tests", "fakes.py"))
    return attach(session)


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
