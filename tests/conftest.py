import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


#: Modules whose tests run whole queries or fits; `-m "not slow"` leaves them out.
SLOW = {"test_queries.py", "test_learning.py", "test_evaluation.py"}


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: runs whole queries, fits or corpus operators")


def pytest_collection_modifyitems(items):
    for item in items:
        if item.path.name in SLOW or item.path.parent.name == "llm":
            item.add_marker(pytest.mark.slow)
