from __future__ import annotations

import pytest

from fiscalspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
