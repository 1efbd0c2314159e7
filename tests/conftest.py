import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                os.path.dirname(os.path.abspath(__file__))]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from oracle import test_session

    return test_session()


@pytest.fixture(scope="session")
def con():
    from oracle import duck

    return duck(SF_DIR)


@pytest.fixture(scope="session")
def frame(spark):
    """Build a DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def rows():
    """A DataFrame's rows as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
