import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidegrid.session import local_session

    session = local_session(shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Two zones, 14 days of hours, a count that depends on hour and zone."""
    rows = spark.range(2 * 14 * 24).selectExpr(
        "cast(if(id % 2 = 0, 161, 132) as int) as PULocationID",
        "timestamp'2024-07-01 00:00:00' + make_dt_interval(0, cast(floor(id / 2) as int)) as hour",
        "cast(10 + pmod(xxhash64(id), 20) + 5 * sin(floor(id / 2) / 24 * 6.283185) as int) as pickup_count",
        "if(id % 2 = 0, 'Manhattan', 'Queens') as Borough",
        "if(id % 2 = 0, 'Midtown Center', 'JFK Airport') as zone_name",
        "'Yellow Zone' as service_zone",
    )
    return rows.persist()
