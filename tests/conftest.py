import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parapet.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


def by(df, key, *columns):
    """Collected rows as {key: value or tuple of values}."""
    pick = lambda r: r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)
    return {r[key]: pick(r) for r in df.collect()}
