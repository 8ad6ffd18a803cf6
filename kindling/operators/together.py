"""Problems that are raised together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.storage import release, saved

#: Baskets that a set has to occur in.
MIN_BASKETS = 3
#: Items in the baskets of a set, counted with their repetitions, that one task mines; larger ones are split by their next item.
SHARD_CELLS = 200_000


def grown(paths: dict[tuple, int], least: int, largest: int) -> Iterator[tuple[tuple, int]]:
    """(items, baskets) of every set of up to ``largest`` items that at least ``least`` baskets hold, by pattern growth.

    ``paths``: ordered baskets with their numbers. A set grows towards the front of its baskets: what stands before an item in them is the
    item's own, smaller input, in which equal beginnings are one.
    """
    counts: dict = {}
    for path, n in paths.items():
        for item in path:
            counts[item] = counts.get(item, 0) + n
    kept = {item for item, n in counts.items() if n >= least}
    below: dict = {item: {} for item in kept}
    for path, n in paths.items():
        path = tuple(item for item in path if item in kept)
        for at, item in enumerate(path):
            if at and largest > 1:
                own = below[item]
                own[path[:at]] = own.get(path[:at], 0) + n
    for item in kept:
        yield (item,), counts[item]
        for more, n in grown(below.pop(item), least, largest - 1) if largest > 1 else ():
            yield (*more, item), n


def frequent_sets(rows: DataFrame, basket: list[str], item: str, least: int = MIN_BASKETS, largest: int = 64, shard: int = SHARD_CELLS) -> DataFrame:
    """(items array, n_items, baskets): each set of two to ``largest`` items that at least ``least`` baskets hold together.

    A row puts ``item`` (a whole number) into the basket of its ``basket`` columns; repeated rows count once, rows with a null in one of them are none.

    Pattern growth, distributed: items of too few baskets go, baskets are ordered by how rare their items are (common first), and equal baskets become one row
    with a number. Each set then has shards of its own, the beginnings of its baskets before its foremost item. A set whose shards are within ``shard`` cells is
    mined in one task; those of a larger one are counted by pre-aggregation and split among the sets that are one item larger, so that a set of any
    number of baskets is nobody's whole input.
    """
    b, i = F.struct(*[F.col(f"`{c}`") for c in basket]).alias("b"), F.col(f"`{item}`").cast("long").alias("i")
    whole = F.col(f"`{item}`").isNotNull()
    for c in basket:
        whole = whole & F.col(f"`{c}`").isNotNull()
    cells = rows.where(whole).select(b, i).distinct()
    often = cells.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    lists = cells.join(often, "i").groupBy("b").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "i"))).alias("path")).where(F.size("path") > 1)
    base = lists.select(F.transform("path", lambda x: x["i"]).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    base = saved(base.select(F.array().cast("array<bigint>").alias("items"), "path", "n"))
    found = "items array<bigint>, baskets long"

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, paths = None, {}
        for batch in batches:
            items = batch.column(0)[0].as_py()
            paths |= {tuple(p): n for p, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())}
        out = [((*more, *items), n) for more, n in grown(paths, least, largest - len(items)) if more]
        for at in range(0, len(out), 100_000):
            part = out[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.list_(pa.int64())), pa.array([n for _, n in part], pa.int64())], names=["items", "baskets"])

    out = rows.sparkSession.createDataFrame([], found)
    for size in range(1, largest + 1):
        sizes = saved(base.groupBy("items").agg(F.sum(F.size("path")).alias("cells")))
        few, many = sizes.where(F.col("cells") <= shard).select("items"), sizes.where(F.col("cells") > shard).select("items")
        out = out.union(saved(base.join(few, "items", "left_semi").groupBy("items").applyInArrow(mine, found)))
        if many.isEmpty():
            break
        # A row for each item of a path, with what stands before it.
        open_ = base.join(many, "items", "left_semi").select("items", "path", "n", F.posexplode("path").alias("at", "i"))
        larger = F.concat(F.array("i"), "items")
        open_ = open_.select(larger.alias("items"), F.slice("path", F.lit(1), F.col("at")).alias("path"), "n")
        counted = saved(open_.groupBy("items").agg(F.sum("n").alias("baskets")).where(F.col("baskets") >= least))
        out = out.union(counted.where(F.size("items") <= largest))
        if size == largest:
            break
        grown_base = open_.where(F.size("path") > 0).join(counted.select("items"), "items", "left_semi").groupBy("items", "path").agg(F.sum("n").alias("n"))
        then = saved(grown_base)
        release(base, sizes)
        base = then
    return out.where(F.size("items") > 1).select(F.sort_array("items").alias("items"), F.size("items").cast("long").alias("n_items"), "baskets")
