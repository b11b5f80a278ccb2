from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures_small import GOLDEN  # noqa: E402
from parcelsight import schemas  # noqa: E402
from parcelsight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Deliveries from the golden row with some fields replaced, one dict per row."""
    def build(*changes: dict):
        rows = [{**GOLDEN, **c} for c in changes]
        names = schemas.DELIVERY.names
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.DELIVERY)
    return build
