import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import create

    s = create("tests", "local[2]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="2g", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__executorEnv__PYTHONPATH=str(Path(__file__).resolve().parents[1]))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
