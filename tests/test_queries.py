import pytest

import __spark_entry__ as entry
from tests.oracle import compare, views

CORE = {k: v for m in entry._modules() if m.__name__.startswith("pressloom.plans") for k, v in m.QUERIES.items()}
SQL = {k: v for m in entry._modules() if m.__name__.startswith("pressloom.plans") for k, v in m.ORACLES.items()}


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, con, name):
    df = CORE[name](spark, data)
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        rows = df.collect()
        assert rows and not any(all(v is None for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["item_id", "field", "utc_us"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
