import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from concord.session import build_session

    s = build_session(
        "concord-tests",
        os.environ.get("TEST_MASTER", "local[8]"),
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
