import duckdb
import pytest

from quaestor.plans import catalog as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).map(lambda v: round(float(v), 5) if isinstance(v, (int, float)) else v).itertuples(index=False)))
    assert rows(got) == rows(want)
