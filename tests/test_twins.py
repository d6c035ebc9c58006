"""Queries against their SQL twins, on tables that hold what the given ones are too small for."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries


def both(spark, tmp_path, name, table, rows, schema):
    """Sorted rows of the query and of its twin over one table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    told = db.sql(oracle_sql()[name])
    at = [told.columns.index(c) for c in got.columns]
    return sorted((tuple(r) for r in got.collect()), key=str), sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=str)


def test_labels_of_many_exact_clusters(spark, tmp_path):
    rows = [(2 * i + k, f"text {i}", "en", "web", 8) for i in range(712) for k in (0, 1)]
    got, told = both(spark, tmp_path, "exact_clusters", "documents", rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert got == told and [r[-1] for r in sorted(got, key=lambda r: r[-2])][702:708] == ["zw", "zx", "zy", "zz", "aaa", "aab"]


def test_clusters_that_share_a_path_have_one_order(spark, tmp_path):
    rows = [(i, "a", "en", "web", size) for i in (1, 2) for size in (3, 1)]
    got, told = both(spark, tmp_path, "exact_clusters", "documents", rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert got == told and len(got) == 2


@pytest.mark.parametrize("key", [25, 26, 701, 702, 18277, 18278, 475253, 475254, 12356629, 12356630, 2 * 10**10])
def test_scalar_functions_of_large_keys(spark, tmp_path, key):
    got, told = both(spark, tmp_path, "scalar_functions", "orders", [(key,)], "o_orderkey long")
    assert got == told
