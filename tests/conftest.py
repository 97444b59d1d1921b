import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tabella.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="tabella-tests-")
    return local_session(4, "tests", **{"spark.checkpoint.dir": f"file:{folder}"})


@pytest.fixture
def split(spark):
    """Force the algorithms for tables too large for one task."""
    spark.conf.set("tabella.singleTaskRows", "0")
    spark.conf.set("tabella.splits", "5")
    yield
    spark.conf.unset("tabella.singleTaskRows")
    spark.conf.unset("tabella.splits")


@pytest.fixture(scope="session")
def small_data():
    return "/root/testdata/sf0.001"
