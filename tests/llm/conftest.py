import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    import data
    return spark.createDataFrame(data.rows(), data.SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    import data
    return spark.createDataFrame([], data.SCHEMA)
