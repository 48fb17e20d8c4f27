import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from studylens.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "studylens-tests")


@pytest.fixture
def table(spark):
    """A small table of strings with row_index; rows are given by column."""

    def make(partitions: int = 2, **columns):
        names = list(columns)
        rows = [(i, *values) for i, values in enumerate(zip(*columns.values(), strict=True))]
        schema = ", ".join(["row_index BIGINT", *(f"{n} STRING" for n in names)])
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


@pytest.fixture
def hits():
    """{rule id: sorted row numbers} of a findings table."""

    def collect(findings, *more):
        found = {}
        for r in findings.collect():
            found.setdefault(r["rule_id"], []).append((r["row_index"], *(r[m] for m in more)) if more else r["row_index"])
        return {rule: sorted(rows) for rule, rows in sorted(found.items())}

    return collect
