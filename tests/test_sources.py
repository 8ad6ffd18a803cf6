"""Ingestion that loses nothing, and publication that writes only what changed."""

import os
from collections import Counter

import pytest

from kindling import storage
from kindling.sources import Feed, ingest_reactions, misfits, publish_changes, publish_tables, published_changes, read_any

SCHEMA = "id int, text string, n int"


@pytest.mark.parametrize("kind, lines, bad", [
    ("csv", ["id,text,n", "1,one,5", "x,two,6", "3,three,y", "4,,7", '5,"a, b",'], ["x,two,6", "3,three,y"]),
    ("json", ['{"id": 1, "text": "one", "n": 5}', '{"id": "x", "text": "two", "n": 6}', '{"id": 3, "text": "three"', "", '{"id": 4, "n": 7}', '{"id": 5, "text": "a, b"}'], ['{"id": "x", "text": "two", "n": 6}', '{"id": 3, "text": "three"']),
])
def test_the_same_rows_whatever_is_asked_for(spark, tmp_path, kind, lines, bad):
    path = f"{tmp_path}/in.{kind}"
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    df = read_any(spark, path, SCHEMA)
    assert df.columns == ["id", "text", "n"]
    assert df.count() == df.select("text").count() == len(df.select("text").collect()) == len(df.collect()) == 3
    assert df.select("id").distinct().count() == 3
    assert sorted(r.id for r in df.where("text is null or n = 5").collect()) == [1, 4]
    feeds = {"a": Feed(path, {"reaction_id": "id", "text": "text"}, schema=SCHEMA)}
    out = ingest_reactions(spark, feeds)
    assert out.count() == out.select("source").count() == 3
    assert [(r.kind, r.path) for r in misfits(spark, feeds).collect()] == [("a", path)] * len(bad)
    assert sorted(r.line for r in misfits(spark, feeds).select("line").collect()) == sorted(bad)
    assert misfits(spark, feeds).count() == len(bad)


def test_misfits_of_tables_that_have_a_schema_of_their_own(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert misfits(spark, {"t": f"{tmp_path}/t.parquet"}).count() == 0


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_changed_partitions_are_written(spark, tmp_path):
    schema = "k string, g int, n int"
    old = [("a", 1, 1), ("a", 1, 1), ("b", 1, None), ("c", 2, 3), ("d", 3, 4), ("e", None, 5), ("f", 4, 6)]
    new = [("a", 1, 1), ("b", 1, None), ("c", 2, 3), ("e", None, 5), ("e", None, 5), ("f", 4, 6), ("g", 5, 7), ("g", 5, 7)]
    path = publish_tables({"t": spark.createDataFrame(old, schema)}, str(tmp_path), {"t": ["g"]})["t"]
    before = files(path)
    changes = publish_changes(spark.createDataFrame(new, schema), path, ["g"])
    want = Counter({("a", 1, 1, "removed"): 1, ("d", 3, 4, "removed"): 1, ("e", None, 5, "added"): 1, ("g", 5, 7, "added"): 2})
    assert Counter(tuple(r) for r in changes.collect()) == want
    table = spark.read.schema(schema).parquet(path).select("k", "g", "n")
    assert Counter(tuple(r) for r in table.collect()) == Counter(new)
    after = files(path)
    kept = {f for f in before if "g=2" in f or "g=4" in f}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any("g=3" in f for f in after)
    assert not any(f in after for f in before if "g=1" in f)
    assert publish_changes(spark.createDataFrame(new, schema), path, ["g"]).count() == 0
    assert files(path) == after


def test_changes_go_by_name_and_count_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "n int, k string")
    b = spark.createDataFrame([("x", 1), ("z", 2), ("y", None)], "k string, n int")
    assert Counter(tuple(r) for r in published_changes(a, b).collect()) == Counter({("x", 1, "removed"): 1, ("z", 2, "added"): 1})


def test_a_published_partition_is_one_file(spark, tmp_path):
    df = spark.range(4000).selectExpr("id", "cast(id % 7 as int) as g").repartition(16)
    path = publish_tables({"t": df}, str(tmp_path), {"t": ["g"]})["t"]
    assert len(files(path)) == 7


def test_folders_go_with_their_scratch(spark):
    with storage.scratch(spark):
        path = storage.fresh_folder(spark)
        spark.range(1).write.parquet(path)
        assert os.path.isdir(path.removeprefix("file:"))
    assert not os.path.isdir(path.removeprefix("file:"))
