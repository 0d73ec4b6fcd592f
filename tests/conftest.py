import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trajflow.session import local_session  # noqa: E402
from trajflow.sources.schema import CHECKIN_POSITIONED  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


DEFAULTS = {
    "row_pos": 0,
    "user_id": "1",
    "POI_id": "A",
    "POI_catid": "cid3",
    "POI_catid_code": 3,
    "POI_catname": "Coffee Shop",
    "POI_category": "Food and Dining",
    "latitude": 40.70,
    "longitude": -74.00,
    "UTC_time": "2024-01-01T10:00:00",
    "local_time": "2024-01-01 10:00:00",
    "day_of_week": 1,
    "norm_in_day_time": 0.42,
    "trajectory_id": "1_0",
}


@pytest.fixture(scope="session")
def checkins(spark):
    """Build check-ins from partial rows; positions follow the list."""

    def build(rows):
        full = [{**DEFAULTS, "row_pos": i, **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in DEFAULTS) for r in full], CHECKIN_POSITIONED)

    return build


@pytest.fixture(scope="session")
def rows_of():
    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in chosen.collect()), key=repr)

    return collect
