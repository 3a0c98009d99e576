import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "l_linenumber", "l_quantity"]


@pytest.mark.parametrize("name", ["filter_three_valued", "filter_nan", "join_left_limit", "vector_l2_topk_where", "queue_rest", "stream_trim", "unique_index", "refusals", "commit_keeps", "delete_few_join", "prepared_where", "join_null_keys", "vector_null_zero", "lease_ack", "consume_is_atomic"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "customer", "orders", "documents", "labels", "embeddings", "events", "part", "region"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rows = c.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: [(x is None, x) if not isinstance(x, str) else (False, x) for x in r]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rows, key=key)
