import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from speechmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Value of a column expression over one row of named string cells."""

    def evaluate(expression, **cells):
        schema = ", ".join(f"{name} string" for name in cells) or "x string"
        return spark.createDataFrame([tuple(cells.values()) or ("",)], schema).select(expression.alias("v")).first()["v"]

    return evaluate
