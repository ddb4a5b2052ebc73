from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session(int(os.environ.get("TEST_CPUS", "8")))
    yield built
    built.stop()
