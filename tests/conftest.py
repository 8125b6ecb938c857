import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tabwise.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tabwise-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_held(spark):
    """What a module's tests cached is not there for the next module's."""
    yield
    spark.catalog.clearCache()
