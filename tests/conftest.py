from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from waymark.session import local_session  # noqa: E402

T0 = datetime(2026, 9, 20, 10, 0, 0)
EVENT_SCHEMA = ("seq bigint, session_id string, user_id string, timestamp timestamp, event string, page string, "
                "product_id string, order_id string, metadata map<string,string>")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def ev(t, event, page, product=None, session="s_1", user="u_1", order=None, **metadata):
    return (session, user, T0 + timedelta(seconds=t), event, page, product, order,
            {k: str(v) for k, v in metadata.items()})


@pytest.fixture(scope="session")
def frame(spark):
    def build(rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT_SCHEMA)

    return build


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("benchmark tables are not on this machine")
    return SF


def rows(df, *order):
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]
