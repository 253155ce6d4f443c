import duckdb
import pytest

import __spark_entry__ as entry
from deskgrain.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "rank_fusion", "policy_ranking", "source_type_merge", "neighbour_expansion", "reingest_plan", "source_conflicts",
    "evaluation_summary", "daily_metrics", "source_status", "stream_daily_metrics",
]


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 80


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(norm, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall())
    assert got == want
