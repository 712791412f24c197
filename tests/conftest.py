from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weftline.session import local_session

    session = local_session(4, shuffle_partitions=4, driver_memory="4g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
