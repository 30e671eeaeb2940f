import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from candlewick.session import build_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", "local[8]", 8, **{
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from check import connect

    return connect(SMALL)
