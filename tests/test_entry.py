import duckdb
import pytest

import __spark_entry__
from docspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def text(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(text(r[k]) for k in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(r.asDict() for r in got.collect()) == plain(dict(zip(names, r)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(found) and set(sql) <= set(found)
