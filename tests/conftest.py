from __future__ import annotations

import pytest

from tidewatch.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = local_session(cpus=8, shuffle_partitions=4, memory="6g", more={"spark.sql.warehouse.dir": str(root / "warehouse")})
    yield session
    session.stop()
