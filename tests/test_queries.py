"""Registered queries against their SQL on the smallest tables.

All of them with CLAUSEWISE_ALL_QUERIES=1; a spread of them otherwise.
"""

import os

import duckdb
import pytest

from clausewise.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SOME = ("scenario_composite", "metric_specs", "public_mapping", "clauses", "check_scores", "schema_fields",
        "ranked_evidence", "regulation_summary", "policy_split", "nb_predictions", "threshold_sweep",
        "top_contributors", "policy_flat", "practice_stats", "mixed_examples", "articles", "numbered_clauses",
        "sparse_topk", "alignment", "stream_tallies")
CHOSEN = sorted(catalog.oracle_sql()) if os.environ.get("CLAUSEWISE_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


def test_every_sql_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got or name in ("metrics_shape",)
