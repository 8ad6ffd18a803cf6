"""Variable-capacity best-fit packing of documents into training sequences.

The packing is decided on counts: how many pieces of each length there are. That table has at most
as many rows as the largest capacity has tokens, however many documents there are, so that
best-fit runs over all of them at once; Spark counts the lengths, numbers the pieces of each
length, and deals the numbered pieces to the bins of the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.llm.common import small
from kindling.storage import saved

#: Permitted sequence lengths in tokens.
CAPACITIES = (256, 512, 1024, 2048)
#: Pieces of one length that are numbered in one part, on average; a common length has as many parts as it needs.
PART = 50_000


def word_count(text: Column) -> Column:
    """Tokens of a text: runs of other than white space. Null and blank texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


def sequence_cost(capacity: int) -> float:
    """Work of a sequence, in tokens: its places, what any sequence costs, and attention, which grows with the square."""
    return capacity + 16 + capacity * capacity / 8192


def plan_bins(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> dict[str, np.ndarray]:
    """Best-fit decreasing over ``counts`` (length -> pieces), with several capacities.

    Lengths fall; pieces of one length fill the open bins with the least room first, a bin as
    often as it holds them. When none has room, bins are opened of the capacity that costs least
    per token that will fill it: a bin of capacity c has ``cost(c)`` and will be filled by pieces of
    this length and by what shorter pieces there are. At the end each bin gets the least permitted capacity
    that holds its contents. Bins that were treated alike are one group with a count.

    Returns columns: entries (length, first: number of the first such piece of this length,
    group, each: pieces per bin, offset: tokens before them in the bin) and groups (start: first bin
    number, size: final capacity, used).
    """
    sizes = sorted(set(capacities))
    largest = sizes[-1]
    room: list[tuple[int, int]] = []  # (free tokens, group), sorted
    group = {"n": [], "cap": [], "used": [], "parts": []}
    below = 0  # tokens in pieces of lesser length
    todo = sorted(counts.items(), reverse=True)
    if todo and todo[0][0] > largest:
        raise ValueError(f"a piece of {todo[0][0]} tokens is longer than the largest capacity, {largest}")
    volume = sum(length * n for length, n in todo)

    def add(n: int, cap: int, used: int, parts: list) -> int:
        for k, v in (("n", n), ("cap", cap), ("used", used), ("parts", parts)):
            group[k].append(v)
        return len(group["n"]) - 1

    def put(g: int, length: int, each: int, bins: int, free: int, left: int) -> int:
        """``each`` pieces into each of the first ``bins`` bins of group g, the others split off; pieces left."""
        if bins < group["n"][g]:
            after = [(size, k, offset, first + k * bins) for size, k, offset, first in group["parts"][g]]
            rest = add(group["n"][g] - bins, group["cap"][g], group["used"][g], after)
            insort(room, (free, rest))
            group["n"][g] = bins
        group["parts"][g].append((length, each, group["used"][g], counts[length] - left))
        group["used"][g] += length * each
        if free - length * each > 0:
            insort(room, (free - length * each, g))
        return left - each * bins

    for length, n in todo:
        volume -= length * n
        below, left = volume, n
        while left and length:
            at = bisect_left(room, (length, -1))
            if at < len(room):
                free, g = room.pop(at)
                each, bins = free // length, group["n"][g]
            else:
                fit = [c for c in sizes if c >= length]
                same = left * length
                cap = min(fit, key=lambda c: (cost(c) / min(c, (min(c, same) // length) * length + min(c, below)), c))
                free, each = cap, cap // length
                bins = max(1, left // each)
                g = add(bins, cap, 0, [])
            if left >= each * bins:
                left = put(g, length, each, bins, free, left)
            elif left >= each:
                left = put(g, length, each, left // each, free, left)
            else:
                left = put(g, length, left, 1, free, left)
    final = np.array([sizes[bisect_left(sizes, u)] for u in group["used"]], dtype=np.int64)
    bins = np.array(group["n"], dtype=np.int64)
    entries = sorted((length, first, g, each, offset) for g, parts in enumerate(group["parts"]) for length, each, offset, first in parts)
    columns = np.array(entries, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "group", "each", "offset"), columns)) | {"start": np.concatenate([[0], np.cumsum(bins)[:-1]]), "bins": bins, "size": final, "used": np.array(group["used"], dtype=np.int64)}


def _numbered(pieces: DataFrame, counts: dict[int, int], part: int) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, .. within each length. A length's pieces are numbered in parts of about ``part`` of
    them, dealt by a hash, as many as its count asks for; a part starts where the parts before it end."""
    parts = [[length, max(1, -(-n // part))] for length, n in sorted(counts.items())]
    parts = pieces.sparkSession.createDataFrame(parts, "tokens long, parts long")  # a row per length, bounded by the largest capacity
    pieces = pieces.join(F.broadcast(parts), "tokens").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "tie"), F.col("parts")))
    held = pieces.groupBy("tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(held.select("tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")))
    inside = Window.partitionBy("tokens", "salt").orderBy("id", "piece", "tie")
    ranked = pieces.withColumn("at", F.row_number().over(inside) - 1)
    return ranked.join(small(starts), ["tokens", "salt"]).withColumn("number", F.col("from") + F.col("at")).drop("salt", "parts", "from", "at")


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost, tokens: Column | None = None,
) -> DataFrame:
    """One row per piece of a document: ``key``, piece, start, n_tokens, bin_id, bin_capacity, bin_used, bin_offset.

    A document's tokens (``tokens``, by default its words) are cut into pieces of the largest
    capacity and a rest. Tokens ``start`` to ``start + n_tokens`` of the document stand in sequence
    ``bin_id`` from token ``bin_offset`` on; the sequence has ``bin_capacity`` places, of which
    ``bin_used`` are filled. Texts that are null, empty or blank have one row with n_tokens 0 and no bin.
    Repeated rows and null keys are packed as any other; equal rows are placed in any order.
    An empty table gives no rows; other columns are not read. What the driver holds, and tasks are
    sent, is bounded by the largest capacity.
    """
    largest = max(capacities)
    n = (word_count(F.col(text).cast("string")) if tokens is None else tokens).cast("long")
    rows = docs.select(F.col(key).alias("id"), n.alias("total"), F.xxhash64(F.col(text).cast("string")).alias("tie"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / largest) - 1, F.lit(0)))
    pieces = rows.select("id", "tie", "total", F.explode(cuts).alias("piece"))
    pieces = saved(pieces.select("id", "tie", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("total") - F.col("piece") * largest, F.lit(largest)).alias("tokens")))
    counts = {r["tokens"]: r["n"] for r in pieces.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(plan_bins(counts, capacities, cost))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        wide = 1 << 44  # pieces of one length are fewer
        places = p["length"] * wide + p["first"]
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("tokens", "number"))
            e = np.searchsorted(places, length * wide + number, side="right") - 1
            within = number - p["first"][e]
            g = p["group"][e]
            bin_id = p["start"][g] + within // p["each"][e]
            offset = p["offset"][e] + within % p["each"][e] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *(pa.array(x) for x in (bin_id, p["size"][g], p["used"][g], offset))], names=names,
            )

    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "piece", "start", "n_tokens", "bin_id", "bin_capacity", "bin_used", "bin_offset"]
    schema = f"id {kind}, piece long, start long, n_tokens long, bin_id long, bin_capacity long, bin_used long, bin_offset long"
    numbered = _numbered(pieces.where("tokens > 0"), counts, PART)
    packed = numbered.select("id", "piece", "start", "tokens", "number").mapInArrow(deal, schema)
    none = pieces.where("tokens = 0").select("id", "piece", "start", F.col("tokens").alias("n_tokens"), *[F.lit(None).cast("long").alias(c) for c in names[4:]])
    return packed.union(none).withColumnRenamed("id", key)
