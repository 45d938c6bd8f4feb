from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark import workspace as ws  # noqa: E402
from tidemark.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    """A new folder below the shared root; never cleared."""
    return ws.fresh_folder(spark, "test")


@pytest.fixture(scope="session")
def data():
    if not TESTDATA.exists():
        pytest.skip("no test tables")
    return str(TESTDATA)
