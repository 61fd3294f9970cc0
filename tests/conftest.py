import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from codestrata.session import local_session, ship_package

    s = local_session("4", **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"})
    ship_package(s)
    yield s
    s.stop()
