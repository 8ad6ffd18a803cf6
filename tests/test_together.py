import random
from itertools import combinations

import pytest

from kindling.operators import together as T


def by_counting(baskets, least, largest=99):
    counts = {}
    for b in baskets:
        for n in range(2, min(len(b), largest) + 1):
            for s in combinations(sorted(b), n):
                counts[s] = counts.get(s, 0) + 1
    return {s: n for s, n in counts.items() if n >= least}


@pytest.mark.parametrize("shard", [0, 60, 10**6])
@pytest.mark.parametrize("largest", [2, 3, 64])
def test_equals_counting_all_subsets(spark, shard, largest):
    """Whether every set is split, some are, or one task mines all."""
    rng = random.Random(shard + largest)
    baskets = [{i for i in range(9) if rng.random() < 0.2 + 0.08 * i} for _ in range(60)]
    rows = [(n, f"d{n % 2}", i) for n, b in enumerate(baskets) for i in b for _ in range(rng.randrange(1, 3))]
    df = spark.createDataFrame(rows, "a int, b string, items int").repartition(3)
    got = [(tuple(r["items"]), r.n_items, r.baskets) for r in T.frequent_sets(df, ["a", "b"], "items", least=5, largest=largest, shard=shard).collect()]
    want = by_counting(baskets, 5, largest)
    assert len(got) == len(want)
    assert {(s, n): c for s, n, c in got} == {(s, len(s)): c for s, c in want.items()}


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, 5), (1, 6), (1, 6), (2, 5), (2, 6), (None, 5), (None, 6), (3, None), (3, 5), (4, 5), (4, 6)]
    df = spark.createDataFrame(rows, "k int, i int")
    assert [(r["items"], r.n_items, r.baskets) for r in T.frequent_sets(df, ["k"], "i").collect()] == [([5, 6], 2, 3)]
    assert T.frequent_sets(df, ["k"], "i", least=4).count() == 0
    assert T.frequent_sets(df.where("false"), ["k"], "i").count() == 0


def test_a_third_of_the_baskets_are_one(spark):
    rows = [(n, i) for n in range(900) for i in ((1, 2, 3) if n % 3 else (n, n + 1))]
    out = T.frequent_sets(spark.createDataFrame(rows, "k int, i int"), ["k"], "i", least=100, shard=10)
    assert {tuple(r["items"]): r.baskets for r in out.collect()} == {(1, 2): 600, (1, 3): 600, (2, 3): 600, (1, 2, 3): 600}
