"""Small tables with the cases every operator must take."""

import pytest

from cases import COLUMNS, ODD, rows


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts: spark.createDataFrame(rows(texts), COLUMNS)


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
