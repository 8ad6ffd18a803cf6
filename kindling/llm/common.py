"""What several operators share: batches of bounded size, whole-word
hashing on byte arrays, candidate pairs from buckets, and connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from kindling.storage import release, saved

#: Characters that a task works on at once; its temporary arrays are a few dozen times this.
BLOCK_CHARS = 150_000
#: Rows of two longs that a join may broadcast once they are counted (about 30 MB).
BROADCAST_ROWS = 1_000_000


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``limit`` characters; null is the empty text."""
    start, run, held = 0, [], 0
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        if run and held + len(text) > limit:
            yield start, run
            start, run, held = i, [], 0
        run.append(text)
        held += len(text)
    if run:
        yield start, run


def let(value: Column, body) -> Column:
    """``body`` over ``value`` with ``value`` computed once: higher-order functions inline
    what they refer to, a lambda variable is bound."""
    return F.transform(F.array(value), body)[0]


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, *lists: Column) -> DataFrame:
    """``df`` marked for a broadcast join if its rows, now counted, are within BROADCAST_ROWS; what stands in arrays counts too, by
    their sizes (``lists``). Beyond that for a shuffled join that splits hot keys. ``df`` should be a written table."""
    cells = F.lit(1)
    for size in lists:
        cells = cells + F.coalesce(size, F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(cells)).first()[0] or 0) <= BROADCAST_ROWS else df.hint("merge")


def pairs_of_buckets(members: DataFrame, key: str, node: str) -> tuple[DataFrame, DataFrame]:
    """Star pairs of each bucket: (``a``, ``b``) with ``a`` the least node of the bucket.

    ``members`` may repeat rows. Returns the distinct pairs and, of buckets that may hold three
    nodes and more, the memberships (``key``, ``node``) for looking at them as a whole. A bucket of n nodes gives n-1 pairs;
    counting is pre-aggregated, so that a hot bucket is not gathered in one task.
    """
    sizes = saved(
        members.groupBy(key)
        .agg(F.min(node).alias("lo"), F.max(node).alias("hi"), F.count("*").alias("n"))
        .where("lo <> hi")
    )
    heavy = sizes.where("n > 2").select(key, "lo")
    large = saved(members.join(small(heavy), key).distinct())
    pairs = saved(
        sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        .union(large.where(F.col(node) != F.col("lo")).select("lo", F.col(node)))
        .distinct()
    )
    release(sizes)
    return pairs, large.select(key, node)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``id``, ``component``) for every node of ``edges`` (``a``, ``b`` longs): the least id reachable.

    Distributed union-find: in each round every root hooks onto its least neighbour, paths are
    halved twice, and edges and labels move to the new roots; edges inside a tree go. Every step
    is a pre-aggregated minimum or an equi-join that Spark may split where a root is hot.
    Null ends are ignored; no edges give no rows.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        hooks = saved(
            edges.select("b", "a").union(edges.select(F.col("a").alias("b"), "a"))
            .groupBy("b").agg(F.min("a").alias("p")).select(F.col("b").alias("n"), "p")
        )
        # Roots of a round are counted once: nodes fall from round to round, and so do the joins' sides.
        side = F.broadcast if hooks.count() <= BROADCAST_ROWS else lambda df: df.hint("merge")
        up = hooks
        for _ in range(2):
            up = up.join(side(up.select(F.col("n").alias("p"), F.col("p").alias("q"))), "p").select("n", F.col("q").alias("p"))
        up = saved(up)
        if labels is None:
            labels, told = up.select(F.col("n").alias("id"), F.col("p").alias("component")), None
        else:
            moved = saved(
                labels.join(side(up.withColumnRenamed("n", "component")), "component", "left")
                .select("id", F.coalesce("p", "component").alias("component"))
            )
            release(told)
            labels = told = moved
        left = saved(
            edges.join(side(up.select(F.col("n").alias("a"), F.col("p").alias("pa"))), "a")
            .join(side(up.select(F.col("n").alias("b"), F.col("p").alias("pb"))), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        release(edges, hooks, up if told is not None else None)
        edges = left
    raise RuntimeError(f"components are not complete after {max_rounds} rounds")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves about half of the output bits."""
    y = x >> np.uint64(32)
    y ^= x
    shifted = np.empty_like(y)  # large temporaries cost more than the arithmetic
    for _ in range(2):
        y *= np.uint64(0xD6E8FEB86659FD93)
        np.right_shift(y, np.uint64(32), out=shifted)
        y ^= shifted
    return y


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(out)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand.

    Prefix sums of byte * base^position, made free of the position by the inverse base.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    part = sums[1:]
    part[:] = data
    part += np.uint64(1)
    part *= _powers("up", _BASE, len(data))
    np.cumsum(part, out=part)
    return mixed((sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(data) + 1)[starts])


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, first word of each text and the total, first byte of each text and the end).

    Words are runs of ASCII letters and digits and of whatever is beyond ASCII.
    """
    data = np.frombuffer(b"\n" + b"".join(t + b"\n" for t in texts), dtype=np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    begin = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return data, starts, ends, np.searchsorted(starts, begin), begin


class HashTable:
    """64-bit hashes -> their numbers, for looking up many hashes of which few are there."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.known = hashes[self.order]
        self.there = np.zeros(1 << 20, dtype=bool)
        self.there[self.known & np.uint64((1 << 20) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes`` that are known, the numbers of the hashes there)."""
        if not len(self.known):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.there[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        real = self.known[at] == hashes[maybe]
        return maybe[real], self.order[at[real]]


def in_fold(key: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; for a null id it is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, where: Column, key: str, text: str, label: str, each: int, chars: int,
) -> tuple[list[str], np.ndarray, tuple[float, float]]:
    """(whole texts, their 0/1 labels, the shares of the classes among all labels) for fitting.

    At most ``each`` documents of a class with ``where`` (over ``id``), drawn by a hash of the id, and at most ``chars`` characters, of
    which each class has half and what the other leaves: a document that does not fit into what is left is passed over, those after it are not. A class of which
    none fits gives its shortest. Several labels of one id: the largest; several texts: the one of least hash; null ids and labels are left out.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(where).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(each) for y in (0, 1)]
    bodies = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    bodies = bodies.withColumns({"h": F.xxhash64("body"), "n": F.length("body")})
    sizes = bodies.join(F.broadcast(drawn[0].union(drawn[1])), "id").groupBy("id", "y").agg(F.min(F.struct("h", "n")).alias("text"), F.xxhash64("id").alias("draw"))
    rows = sorted(sizes.select("id", "y", "text.*", "draw").collect(), key=lambda r: (r["draw"], str(r["id"])))
    taken = [r for y in (0, 1) for r in _fitting([r for r in rows if r["y"] == y], _half(rows, y, chars))]
    if not taken:
        return [], np.zeros(0, dtype=np.int64), (1.0, 0.0)
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["y"], r["h"]) for r in taken], StructType([bodies.schema["id"], StructField("y", IntegerType()), StructField("h", LongType())]))
    found = bodies.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "y").agg(F.min("body").alias("body")).collect()
    found.sort(key=lambda r: (str(r["id"]), r["body"]))
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    return [r["body"] for r in found], np.array([r["y"] for r in found], dtype=np.int64), (1 - share, share)


def _half(rows: list, y: int, chars: int) -> int:
    """The characters of class ``y``: half of ``chars``, and what the other class leaves of its half."""
    other = sum(r["n"] for r in rows if r["y"] != y)
    return chars - min(other, chars // 2)


def _fitting(rows: list, chars: int) -> list:
    """The rows that fit into ``chars`` one after another; the shortest if none does."""
    out = []
    for r in rows:
        if r["n"] <= chars:
            chars -= r["n"]
            out.append(r)
    return out or sorted(rows, key=lambda r: r["n"])[:1]
