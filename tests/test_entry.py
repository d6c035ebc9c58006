"""The registry: keys pair up, and a few queries equal their SQL twins on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60


@pytest.mark.parametrize("name", ["dup_groups_report", "edges_balanced", "exact_clusters", "incremental_diff", "match_ready", "probe_parse", "cache_lookup", "stream_microbatch"])
def test_equals_sql(spark, name):
    got = entry.queries()[name](spark, FOLDER)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    said = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in said.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda all_rows, cols: sorted(repr([str(r[cols.index(c)]) for c in sorted(cols)]) for r in all_rows)
    assert rows(got.collect(), got.columns) == rows(said.fetchall(), names)
