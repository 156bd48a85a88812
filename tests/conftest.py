import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from graphloom.session import build_session, prepare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = prepare(build_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4"}))
    yield session
    session.stop()
