import duckdb
import pytest

from signalspark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_is_its_sql(spark, db, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(ours)
        return
    theirs = db.execute(registry.ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)
