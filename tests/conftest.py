import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from session import duck, local_session  # noqa: E402

from gapwise.ordered import GROUP_ROWS_CONF  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def con():
    return duck(FOLDER)


@pytest.fixture
def group_rows(spark):
    """Set the row bound of a task; the default comes back afterwards."""
    yield lambda n: spark.conf.set(GROUP_ROWS_CONF, str(n))
    spark.conf.unset(GROUP_ROWS_CONF)
