import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lawloom.session import build_session  # noqa: E402

DATA = os.environ.get("LAWLOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(4, shuffle_partitions=4, app="lawloom-tests")
    session.conf.set("lawloom.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables are not here")
    return DATA
