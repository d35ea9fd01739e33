import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glyphist.session import configure, ship_with_tasks  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ship_with_tasks()
    builder = SparkSession.builder.master("local[4]").appName("tests")
    builder = builder.config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", "4g")
    session = configure(builder.config("spark.ui.showConsoleProgress", "false")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL
