import datetime as dt
import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from kindling.functions import micros
from kindling.operators import timeline as T


@pytest.fixture
def blocks(spark):
    """Several blocks also on small tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_as_of(left, right):
    out = []
    for i, k, t in left:
        before = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and r[1] <= t]
        out.append((i, k, t, max(before, key=lambda r: r[1:3])[3] if before else None, len(before)))
    return sorted(out)


@pytest.mark.parametrize("keys, times, n", [(5, 40, 300), (1, 1000, 400), (2, 1, 300), (400, 5, 300)])
def test_as_of_equals_looking_back(spark, blocks, keys, times, n):
    """Also with one hot key, and with one time for all."""
    rng = random.Random(keys)

    def cell(m):
        return None if rng.random() < 0.05 else rng.randrange(m)

    right = [(cell(keys), cell(times), i, None if rng.random() < 0.1 else f"r{i}") for i in range(n)]
    left = [(i, cell(keys), cell(times)) for i in range(n)]
    a = spark.createDataFrame(left, "r long, k int, t int").repartition(3)
    b = spark.createDataFrame([(k, t, s, v, 1) for k, t, s, v in right], "k int, t int, seq long, l string, block int").repartition(3)
    got = sorted((tuple(x) for x in T.as_of_join(a, b, "k", "t", ["l"], "seq", count="n").collect()))
    assert got == plain_as_of(left, right)


def test_as_of_of_nothing(spark):
    a = spark.createDataFrame([(1, 2, 3)], "i int, k int, t int")
    b = spark.createDataFrame([], "k int, t int, seq long, v string")
    assert [tuple(r) for r in T.as_of_join(a, b, "k", "t", ["v"], "seq").collect()] == [(1, 2, 3, None)]
    assert T.as_of_join(a.where("i = 0"), b, "k", "t", ["v"], "seq", count="n").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        T.as_of_join(a, b, "k", "t", ["t"], "seq")


def test_a_hot_key_has_several_blocks(spark, blocks):
    a = spark.range(4000).select(F.col("id").alias("i"), F.lit(1).alias("k"), (F.col("id") * 2).alias("t"))
    b = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") * 2 + 1).alias("t"), F.col("id").alias("seq"))
    out = T.as_of_join(a, b, "k", "t", ["seq"], "seq", count="n")
    assert out.where("coalesce(seq, -1) <> i - 1 or n <> i").count() == 0
    assert out.count() == 4000


def test_volume_when_saved(spark):
    day = dt.datetime(2024, 1, 1)
    reactions = spark.createDataFrame(
        [(1, day, 7, "a"), (2, day, 7, "b"), (3, day + dt.timedelta(1), 7, "c"), (4, None, 7, "d"), (5, day, None, "e")], "reaction_id long, ts timestamp_ntz, problem_id int, source string"
    )
    log = spark.createDataFrame(
        [(1, "problem", 7, day, "save", 0, 0), (2, "problem", 7, day - dt.timedelta(1), "save", 0, 0), (3, "problem", 7, day + dt.timedelta(9), "save", 0, 0), (3, "problem", 7, day + dt.timedelta(10), "unsave", 0, 0),
         (4, "problem", 8, day, "save", 0, 0), (5, "idea", 7, day, "save", 0, 0), (6, "problem", None, day, "save", 0, 0), (7, "problem", 7, None, "save", 0, 0)],
        "maker_id long, item_kind string, item_id long, ts timestamp_ntz, action string, seq1 long, seq2 long",
    )
    got = {r.maker_id: (r.volume, r.reaction_id, r.source) for r in T.score_when_saved(log, reactions).collect()}
    assert got == {1: (2, 2, "b"), 2: (0, None, None), 3: (3, 3, "c"), 4: (0, None, None), 6: (0, None, None), 7: (0, None, None)}


@pytest.mark.parametrize("longest", [3, 100, 100_000])
def test_interval_join_equals_range_predicate(spark, longest):
    rng = random.Random(longest)
    points = [(i, rng.choice([None, 1, 2, 2, 2]), rng.choice([None, *[rng.randrange(-300, 300)] * 19])) for i in range(300)]
    spans = [(i, rng.choice([None, 1, 2]), s, s + rng.choice([-1, 0, 1, rng.randrange(longest), longest])) for i in range(60) for s in [rng.randrange(-300, 300)]] + [(99, 1, None, 5), (98, 1, 5, None)]
    a = spark.createDataFrame([(*p, 0) for p in points], "i long, k int, x long, bin int")
    b = spark.createDataFrame(spans, "j long, k int, s long, e long")
    got = sorted((r.i, r.j) for r in T.interval_join(a, b, "k", F.col("x"), F.col("s"), F.col("e"), 4).collect())
    assert got == sorted((i, j) for i, k, x in points for j, q, s, e in spans if k is not None and k == q and None not in (x, s, e) and s <= x < e)
    assert got


def test_interval_join_copies_few_rows(spark):
    """A long interval stands in two bins, and a point in as many as there are levels."""
    b = spark.createDataFrame([(1, 1, 5, 5 + 10**12), (2, 1, 0, 3)], "j long, k int, s long, e long")
    a = spark.range(100).select(F.lit(1).alias("k"), "id")
    out = T.interval_join(a, b, "k", F.col("id"), F.col("s"), F.col("e"), 10)
    assert out.count() == 95 + 3
    assert T.interval_join(a, b.where("false"), "k", F.col("id"), F.col("s"), F.col("e"), 10).count() == 0


def cheapest(days):
    """Of all paths the cheapest, and of those the calmest from the end backwards."""
    best = None
    for path in product((0, 1), repeat=len(days)):
        cost = sum(b if s else c for s, (c, b, _) in zip(path, days)) + sum(d[2] for d, s, p in zip(days, path, (0, *path)) if s > p)
        if best is None or (cost, path[::-1]) < best:
            best = (cost, path[::-1])
    return best[1][::-1]


def test_burst_path_equals_all_paths():
    rng = random.Random(1)
    for _ in range(300):
        days = [(rng.randrange(6), rng.randrange(6), 3) for _ in range(rng.randrange(1, 10))]
        path, first = T.BurstPath(), dt.date(2024, 1, 1)
        for i, (c, b, enter) in enumerate(days):
            path.eval({"problem_id": 1, "day": first + dt.timedelta(i), "mentions": i, "calm": c, "burst": b, "enter": enter})
        got = [0] * len(days)
        out = list(path.terminate())
        for _, start, end, n, mentions, gain in out:
            at = range((start - first).days, (end - first).days + 1)
            assert (n, mentions, gain) == (len(at), sum(at), sum(days[i][0] - days[i][1] for i in at))
            for i in at:
                got[i] = 1
        assert tuple(got) == cheapest(days)
        assert out == sorted(out)


def test_bursts_of_a_series(spark):
    first = dt.date(2024, 1, 1)
    counts = {1: [1] * 10 + [20, 25] + [1] * 8, 2: [10] * 20, 3: [0] * 20, 4: [0] * 19 + [9], 5: [10] * 20, 6: [10] * 20}
    series = spark.createDataFrame([(p, first + dt.timedelta(i), n) for p, c in counts.items() for i, n in enumerate(c)], "problem_id int, day date, mentions long")
    got = [(r.problem_id, r.burst_start.day, r.burst_end.day, r.days, r.mentions) for r in T.burst_periods(series).orderBy("problem_id").collect()]
    assert got == [(1, 11, 12, 2, 45), (4, 20, 20, 1, 9)]
    c = T.burst_costs(series).where("problem_id = 1 and day = '2024-01-11'").first()
    total, own, on = sum(map(sum, counts.values())), sum(counts[1]), 50
    p = own / total
    assert c.calm == round(-(20 * math.log(p) + (on - 20) * math.log(1 - p)) * 1e6)
    assert T.burst_periods(series.where("false")).count() == 0
    assert T.burst_periods(series.where("problem_id = 2")).count() == 0  # the only problem


def test_mentions_at_the_edges_of_a_burst(spark):
    d = dt.datetime(2024, 3, 31)
    times = [d - dt.timedelta(microseconds=1), d, d + dt.timedelta(hours=47, minutes=59, seconds=59, microseconds=999_999), d + dt.timedelta(days=2), None]
    rows = spark.createDataFrame([(i, 1, t, "s") for i, t in enumerate(times)], "reaction_id long, problem_id int, ts timestamp_ntz, source string")
    bursts = spark.createDataFrame([(1, d.date(), (d + dt.timedelta(1)).date())], "problem_id int, burst_start date, burst_end date")
    assert [r.reaction_id for r in T.mentions_in_bursts(rows, bursts).orderBy("reaction_id").collect()] == [1, 2]


def test_microseconds(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(1970, 1, 1), dt.datetime(2024, 2, 29, 13, 14, 15, 678_901)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    assert [r.m for r in df.select(micros(F.col("ts")).alias("m")).collect()] == [(t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in times]
