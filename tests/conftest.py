from __future__ import annotations

import pytest

from runloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(spark, tmp_path):
    return str(tmp_path)
