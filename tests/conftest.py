import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skytriage.session import build_session

    s = build_session("tests", "local[8]", 4, spark__ui__enabled="false", spark__driver__memory="8g",
                      spark__sql__adaptive__coalescePartitions__enabled="false",  # several blocks even on a handful of rows
                      spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
