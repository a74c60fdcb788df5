import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = oracle.session(4)
    s.sparkContext.setLogLevel("ERROR")
    from mnemolake.session import prepare

    return prepare(s)


@pytest.fixture()
def sliced(monkeypatch):
    """Force the hot-key path of every ordered scan, with tiny slices."""
    from mnemolake.operators import ordered

    monkeypatch.setattr(ordered, "PLAIN_WINDOW_ROWS", 0)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 2)
