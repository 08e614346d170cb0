import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from intel_spark.session import build_session  # noqa: E402

NOW = datetime(2026, 1, 10, 12, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def minutes(n):
    return NOW + timedelta(minutes=n)


def hours(n):
    return NOW + timedelta(hours=n)
