"""One local session for all tests."""

import tempfile

import pytest

from tracewright.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="tracewright-test-")
    session = local_session(4, 4, **{"spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.local.dir": folder, "spark.checkpoint.dir": f"{folder}/shared"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
