from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from merchlight.session import local_session  # noqa: E402

TABLES = os.environ.get("MERCHLIGHT_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("merchlight-tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES


START = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return START + dt.timedelta(days=n)


@pytest.fixture
def series(spark):
    """A day-grain table from a list of values (None skips the date)."""
    def make(values, **more):
        rows = [(day(i), None if v is None else float(v),
                 *[float(col[i]) for col in more.values()])
                for i, v in enumerate(values)]
        schema = ", ".join(["date date", "total_sales double",
                            *[f"{n} double" for n in more]])
        return spark.createDataFrame(rows, schema)
    return make
