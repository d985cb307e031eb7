"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if not k.startswith("op")}
QUERIES = {k: v for k, v in entry_module.queries().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries that SQL can't express; test_exact, test_entities and test_operators hold them against plain versions.
PLAIN = {
    "watch_fuzzy_join", "resolve_ladder", "simhash_near_pairs", "simhash_greedy", "canonical_urls_exact", "html_to_text", "ioc_scan", "ioc_reconcile", "quote_grounding", "identity_ladder", "stix_export", "stix_bundles",
    "country_flags", "neutral_text", "context_windows", "style_breaches", "style_report", "style_worst", "named_actors", "grounded_actors",
}


def test_all_others_are_known():
    assert set(QUERIES) - set(ORACLES) == PLAIN


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_same_on_another_layout(spark, name):
    """The result has rows and doesn't depend on how many tasks a shuffle has."""
    first = rows(QUERIES[name](spark, SF).toPandas())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and first == rows(QUERIES[name](spark, SF).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "n"] and df.count() == 10


def test_pushdown(spark):
    plan = QUERIES["top_groups_window"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan and "TakeOrderedAndProject" in plan
