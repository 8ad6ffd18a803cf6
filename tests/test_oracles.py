"""Every query against the SQL that says the same, over whole tables."""

import os

import duckdb
import pandas as pd
import pytest

import kindling.queries as core

DATA = os.environ.get("KINDLING_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame, types: dict[str, str]) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if types[c] in ("bigint", "int", "double"):
            df[c] = pd.to_numeric(df[c]).astype(float)
        elif types[c] in ("date", "timestamp_ntz"):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).astype(str).values))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, sql = core.queries()[name](spark, DATA), core.oracle_sql()[name]
    types = {r[0]: TYPES[r[1]] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: f.dataType.simpleString() for f in ours.schema} == types
    assert rows(ours.toPandas(), types) == rows(duck.execute(sql).df(), types)


def test_every_query_has_sql_but_those_it_cannot_express():
    assert set(core.queries()) - set(core.oracle_sql()) == {"cluster_reactions", "dedup_near_lsh", "author_sketches"}


def test_clusters_split_the_input(spark):
    from pyspark.sql import functions as F

    out = core.queries()["cluster_reactions"](spark, DATA)
    got = out.agg(F.count("*"), F.countDistinct("vec_id"), F.countDistinct("cluster")).first()
    assert got[0] == got[1] == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert got[2] == 10


def test_minhash_pairs_are_among_the_exact_ones(spark):
    exact = {(r.a, r.b) for r in core.queries()["dedup_near"](spark, DATA).collect()}
    lsh = {(r.a, r.b) for r in core.queries()["dedup_near_lsh"](spark, DATA).collect()}
    assert lsh <= exact
    assert len(lsh) >= 0.8 * len(exact)
