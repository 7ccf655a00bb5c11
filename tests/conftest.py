import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from foliospark.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 8)


@pytest.fixture(scope="session")
def con():
    from verify import open_tables

    return open_tables(SF)


@pytest.fixture
def folder():
    return SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
