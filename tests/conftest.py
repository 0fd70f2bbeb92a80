import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from presslake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("presslake-tests", "local[8]", **{
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        # Catalog tables of the tests (fingerprint indexes) go to a folder of their own.
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="presslake-warehouse-"),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
