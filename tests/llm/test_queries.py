import duckdb
import pytest
from clausewise.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = con.execute(queries.ORACLE[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == want


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
