"""Every query of the library against its oracle, or for rows and a stable schema where it has none."""

import pytest

from quillspark.plans import documents, fidelity, layout, streams
from tests.helpers import assert_same, duck

QUERIES = fidelity.QUERIES | layout.QUERIES | documents.QUERIES | streams.QUERIES
ORACLES = fidelity.ORACLES | layout.ORACLES | documents.ORACLES | streams.ORACLES
#: These may be empty on the smallest tables.
MAY_BE_EMPTY = {"inside_art"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    n = assert_same(df, con, ORACLES[name]) if name in ORACLES else df.count()
    assert n > 0 or name in MAY_BE_EMPTY


def test_every_quality_rule_has_cases(spark, sf_dir):
    got = documents.qa_summary(spark, sf_dir)
    for column in ("numeric", "unit", "formula", "citation", "overall"):
        assert got.where(f"NOT {column}").count() > 0, column
    assert got.where("missing > 0").count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
