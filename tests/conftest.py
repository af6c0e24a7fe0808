import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardline.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("wardline-tests", cores=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def log(spark, sf_dir):
    from wardline.session import checkpoint
    from wardline.sources.access_log import load_log

    return checkpoint(load_log(spark, sf_dir))


@pytest.fixture(scope="session")
def make_log(spark):
    """Log rows from (event_id, seconds, overrides)."""
    from datetime import datetime, timedelta, timezone

    from wardline.sources.schema import ACCESS_LOG

    base = {
        "user_id": "u", "device_id": "d1", "source_ip": "10.0.0.1", "geo_city": "London",
        "geo_lat": 51.51, "geo_lon": -0.13, "resource_accessed": "r1", "action": "read",
        "auth_method": "mfa", "session_duration_s": 60, "bytes_transferred": 1000,
        "success": True, "label": "normal", "role": "standard",
    }
    start = datetime(2024, 3, 1, 12, 0, 0, tzinfo=timezone.utc)

    def build(rows):
        full = [{**base, "event_id": e, "timestamp": start + timedelta(seconds=s), **o} for e, s, o in rows]
        return spark.createDataFrame([tuple(r[n] for n in ACCESS_LOG.names) for r in full], ACCESS_LOG)

    return build
