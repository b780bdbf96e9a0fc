from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from faultlines.session import local_session

    os.environ.setdefault("FAULTLINES_SHARED_DIR", tempfile.mkdtemp(prefix="faultlines-test-"))
    session = local_session("8", "tests", "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
