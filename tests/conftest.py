from __future__ import annotations

import pytest

from folioflow.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "folioflow-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
