import duckdb
import pytest

from strokewise.plans import calibration, catalog, records, shapes, similarity  # noqa: F401  these register their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_same_as_sql(spark, sf_dir, db, name):
    made = catalog.QUERIES[name](spark, sf_dir)
    want = db.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(made.columns) == sorted(names)
    got, want = cells(made.collect(), made.columns), cells(want.fetchall(), names)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, bad[:3]


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
