import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from sievespark.session import local_session

    session = local_session("tests", 8)
    yield session
    from sievespark.sources.stage import release

    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def values(df, *cols):
    """Sorted rows of a DataFrame as tuples."""
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def close(a, b, tol=1e-9):
    return abs(a - b) <= tol
