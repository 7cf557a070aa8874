import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from leadflow.session import build_session, checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="leadflow-tests",
                      extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)          # the session's spark.checkpoint.dir, or a private folder if unset
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
