import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from labelspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        spark__master="local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__sql__shuffle__partitions="4",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """rows, schema → DataFrame over several partitions."""
    return lambda rows, schema, parts=3: spark.createDataFrame(rows, schema).repartition(parts)


@pytest.fixture
def rows_of():
    return lambda df: sorted(tuple(r) for r in df.collect())
