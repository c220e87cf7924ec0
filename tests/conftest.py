from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from returnlens.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app_name="returnlens-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect the given columns as a list of tuples, sorted."""
    return sorted(tuple(r) for r in df.select(*cols).collect())
