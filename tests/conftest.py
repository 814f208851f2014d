import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shopfront.session import local_session
    s = local_session("*", 8, app="shopfront-tests")
    yield s
    s.stop()


def rows(df, order=None):
    """Collect a small test frame as a list of dicts (sorted for comparison)."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda d: tuple((d[k] is None, d[k]) for k in order))
    return out
