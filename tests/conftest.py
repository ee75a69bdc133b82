import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, app="tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": shared,
    })
    yield session
    session.stop()
