import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from kickpool.session import local_session

    return local_session(8)


@pytest.fixture
def one(spark):
    """Value of a Column built from one text or number."""
    from pyspark.sql import functions as F

    def value(build, argument, kind="string"):
        row = spark.createDataFrame([(argument,)], f"x {kind}").select(build(F.col("x"))).first()
        return row[0]

    return value
