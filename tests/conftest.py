from __future__ import annotations

import pytest

from airtide.sources.tables import SNAPSHOT_SCHEMA, STREAMER_SCHEMA
from tests.session import spark_session


@pytest.fixture(scope="session")
def spark():
    return spark_session("4")


@pytest.fixture
def snapshots(spark):
    """Rows of (id, date, time, channel, youtube, twitch, yt_number, tw_number)."""
    return lambda *rows: spark.createDataFrame(list(rows), SNAPSHOT_SCHEMA)


@pytest.fixture
def streamers(spark):
    """Rows of (id, channel_id, channel_name, grp)."""
    return lambda *rows: spark.createDataFrame(list(rows), STREAMER_SCHEMA)
