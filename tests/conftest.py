import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pdengine.session import local_session

    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session", autouse=True)
def written_plans():
    """Plans of everything that is written, so that steps behind staged tables are looked at too."""
    from pyspark.sql import DataFrameWriter

    plain, seen = DataFrameWriter.parquet, []

    def parquet(self, *args, **kwargs):
        plan = self._df._jdf.queryExecution().executedPlan().toString()
        seen.extend(line.strip() for line in plan.splitlines() if "CartesianProduct" in line or "NestedLoopJoin" in line)
        return plain(self, *args, **kwargs)

    DataFrameWriter.parquet = parquet
    yield seen
    DataFrameWriter.parquet = plain


@pytest.fixture(scope="session")
def folder():
    return DATA
