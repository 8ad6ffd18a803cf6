import duckdb
import pandas as pd

from kindling.llm.queries import oracle_sql, queries


def test_sql_says_the_same(spark, sf):
    duck = duckdb.connect()
    for t in ("pages", "documents", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        ours, theirs = queries()[name](spark, sf).toPandas(), duck.execute(sql).df()
        key = sorted(theirs.columns)
        pd.testing.assert_frame_equal(
            ours[key].fillna("").sort_values(key, ignore_index=True), theirs[key].fillna("").sort_values(key, ignore_index=True), check_dtype=False,
        )


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
