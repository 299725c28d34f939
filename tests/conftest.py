import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from provena.session import build

    place = tmp_path_factory.mktemp("checkpoints")
    s = build("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{place}", spark__ui__showConsoleProgress="false")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def smoke() -> str:
    return SMOKE
