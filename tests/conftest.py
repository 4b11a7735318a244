from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricetrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, app="pricetrail-tests")
    # Tiny inputs: few partitions, and no time spent compiling stages.
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root() -> str:
    return "/root/testdata/sf0.001"
