"""Queries against the same SQL in DuckDB, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from meshframe.plans.oracles import ORACLE_SQL
from meshframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "lineitem orders events embeddings".split()
CHOSEN = (
    "morton_encode interleave_3d level1_order forest_levels neighbor_types neighbor_children check_tree tree_offsets write_tree "
    "crop_tree crop_header sample_linear ghost_prolong resample_current slab_with_boundary bipolar_a fan_b curl_slab tdm_slab"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET memory_limit = '3GB'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    tidy = lambda x: round(x, 8) + 0.0 if isinstance(x, float) and not math.isnan(x) else None if isinstance(x, float) else x
    return sorted((tuple(tidy(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark):
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
