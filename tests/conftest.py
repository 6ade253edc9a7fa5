import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from diffloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[8]", "tests", spark_ui_enabled="false", spark_driver_memory="8g",
                      spark_sql_shuffle_partitions="8",
                      spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")), spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
