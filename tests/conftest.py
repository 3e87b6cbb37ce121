from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from gridmill.session import session  # noqa: E402
from gridmill.sources import release_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "gridmill-tests",
        "local[8]",
        spark_ui_enabled="false",
        spark_sql_shuffle_partitions="8",
        spark_driver_memory="4g",
        spark_checkpoint_dir=str(tmp_path_factory.mktemp("scratch")),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    release_scratch(made)
    made.stop()
