import os

import pytest

from covertrace.session import local_session

os.environ.setdefault("COVERTRACE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows(df, *columns):
    """Sorted tuples of a DataFrame's rows."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
