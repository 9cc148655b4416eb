"""Every query that has SQL gives the rows that SQL gives."""

import duckdb
import pytest

from colloquy import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def canonical(rows, columns):
    return sorted(str([str(r[c]) if not isinstance(r[c], float) else repr(r[c]) for c in columns]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, small, duck):
    df = plans.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    cursor = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert canonical((r.asDict() for r in df.collect()), columns) == canonical((dict(zip(names, r)) for r in cursor.fetchall()), columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_others_run(name, spark, small):
    assert plans.QUERIES[name](spark, small).count() >= 0
