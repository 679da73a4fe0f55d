import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tapeloom.session import local_session

    session = local_session("tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("tapeloom.shared.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()
