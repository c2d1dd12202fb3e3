"""One local session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYTHONPATH", ROOT)
    from eventloom.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    session = get_session(
        "tests", "local[3]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=f"file://{shared}",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the shared tables are not here")
    return path
