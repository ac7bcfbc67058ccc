import duckdb
import pytest

from strokewise.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    made = queries.queries()[name](spark, sf_dir)
    assert sorted(made.columns) == sorted(names)
    got = sorted((tuple(r[n] for n in names) for r in made.collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
