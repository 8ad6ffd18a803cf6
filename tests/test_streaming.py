import datetime as dt

import pytest

from kindling.streaming import mention_counts, problem_volume, write_mentions

FIRST = dt.datetime(2024, 1, 1)
SCHEMA = "reaction_id long, ts timestamp_ntz, problem_id int, source string"


def test_stream_counts_as_the_table_does(spark, tmp_path):
    rows = [(i, FIRST + dt.timedelta(hours=7 * i), i % 3, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    write_mentions(mention_counts(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r.problem_id, r.source, r.day_start): r.mentions for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.problem_id, r.source, r.day_start): r.mentions for r in mention_counts(df).collect()}
    newest = max(k[2] for k in want)
    assert got == {k: v for k, v in want.items() if k[2] < newest}  # the last window is still open


@pytest.fixture
def feed(spark, tmp_path):
    """Brings rows to a stream of daily volumes within two days and runs it over what has come; gives all finished days so far."""

    def bring(*rows):
        df = spark.createDataFrame([(i, None if day is None else FIRST + dt.timedelta(days=day), p, "s") for i, day, p in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        write_mentions(problem_volume(stream, "2 days"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        out = spark.read.schema("problem_id int, day_start timestamp_ntz, mentions long").parquet(f"{tmp_path}/out")
        return sorted((r.problem_id, (r.day_start - FIRST).days, r.mentions) for r in out.collect())

    return bring


def test_repeated_late_and_lost_reactions_over_restarts(feed):
    assert feed((1, 0.1, 7), (2, 0.2, 7), (2, 0.2, 7), (3, 0.3, 8)) == []  # day 0 is open
    assert feed((1, 0.1, 7), (4, 1.5, 7), (5, 0.9, 7)) == []  # the first again, from another run; the fifth late, within two days
    assert feed((6, 6.0, 8), (None, 6.0, 8), (7, None, 8), (8, 6.0, None)) == [(7, 0, 3), (7, 1, 1), (8, 0, 1)]
    assert feed((9, 1.1, 7), (6, 6.0, 8)) == [(7, 0, 3), (7, 1, 1), (8, 0, 1)]  # five days late: lost; the sixth again
    assert feed((10, 30.0, 1)) == [(7, 0, 3), (7, 1, 1), (8, 0, 1), (8, 6, 1)]


def test_nothing_new_writes_nothing_twice(feed):
    before = feed((1, 0.1, 7), (2, 9.0, 7))
    assert before == [(7, 0, 1)]
    assert feed((2, 9.0, 7)) == before
