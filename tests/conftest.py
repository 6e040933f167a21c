import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keyloom.session import local_session

    session = local_session(cores=4, memory="4g", partitions=4)
    session.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()


def rows(df, *columns):
    """Rows as sorted tuples, nulls first."""
    data = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(data, key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.fixture(scope="session")
def as_rows():
    return rows
