import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest

#: Rows that every operator on texts must take: nulls, empty, ties, repeats, a clashing column.
ODD = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"),
       (2, None, None), (3, "", "y"), (None, "one two three four five seven", "z"),
       (4, "  \t\n ", None), (5, "word " * 30_000, "long"), (None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with an extra column called as the caller asks."""
    return lambda extra="source": spark.createDataFrame(
        ODD, f"doc_id long, text string, `{extra}` string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
