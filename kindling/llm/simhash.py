"""SimHash near-dedup: a positional byte index with count filtering over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import connected_components, free_name, small
from kindling.storage import release, saved

#: Words of a shingle, hash seed, bits that linked fingerprints may differ in.
WORDS, SEED, RADIUS = 3, 42, 3
#: Positions of equal bytes that a linked pair has at least: three bits touch three of eight bytes.
LEAST_EQUAL = 8 - RADIUS
#: Postings of up to this many fingerprints are compared; larger ones are split first.
POSTING = 512
#: Shingles hashed at once.
BLOCK = 200_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str) -> int:
    """Unsigned SimHash: A-Z lower-cased, words between ASCII white space, 3-word shingles with
    repeats joined by a space (fewer words: all of them), XXH64 with seed 42; a bit is 1 if set in
    over half of the hashes. No words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    last = ends[WORDS - 1 :] if len(words) >= WORDS else ends[-1:]
    counts = np.zeros(2048, dtype=np.int64)
    place = np.arange(8, dtype=np.int64) * 256
    digest = xxhash.xxh64_digest
    for i in range(0, n, BLOCK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : min(n, i + BLOCK)].tolist(), last[i : i + BLOCK].tolist())])
        counts += np.bincount((np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", counts.reshape(8, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _hashed(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py() or "") for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, fp as a signed long) of each row, over the whole text; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _hashed(batch.column(1))], names=["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body")).mapInArrow(run, f"id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def index_masks(levels: int = 4) -> list[list[int]]:
    """Masks of the bits that a posting fixes, level by level.

    Level 0: four byte positions whose numbers XOR to 0. Any five of the eight positions hold
    exactly one such block (they are the Steiner system S(3,4,8)), so that a pair with five equal
    bytes meets in at least one posting of 14. Each next level splits the free bits of a mask into
    four pieces; of these, three differing bits leave one equal. Mask 4*i+j refines mask i. After
    three splits at most 14 bits are free, so that no posting has over 16,384 fingerprints.
    """
    byte = [0xFF << (8 * p) for p in range(8)]
    out = [[sum(byte[p] for p in c) for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]]
    for _ in range(levels - 1):
        finer = []
        for mask in out[-1]:
            free = [b for b in range(64) if not mask >> b & 1]
            size, over = divmod(len(free), 4)
            at = 0
            for j in range(4):
                n = size + (j < over)
                finer.append(mask | sum(1 << b for b in free[at : at + n]))
                at += n
        out.append(finer)
    return out


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Count filter, then verification: at least LEAST_EQUAL equal positional bytes, at most RADIUS bits apart."""
    diff = np.ascontiguousarray(x ^ y)
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (shared >= LEAST_EQUAL) & (np.bitwise_count(diff) <= RADIUS)


def spanning_links(posting: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(fingerprint, those it links to) that span each group of a posting: a search from each unseen
    fingerprint over the unseen rest, in memory linear in the posting."""
    rest = posting
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = linked(rest, at)
            if hit.any():
                yield at, rest[hit]
                front.extend(rest[hit])
                rest = rest[~hit]


def _links(postings: DataFrame) -> DataFrame:
    """(a, b) links that span the groups of each posting (fps array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            two = starts[sizes == 2]
            good = linked(flat[two], flat[two + 1])
            a, b = [flat[two][good]], [flat[two + 1][good]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for at, members in spanning_links(flat[s : s + n]):
                    a.append(np.full(len(members), at, dtype=np.uint64))
                    b.append(members)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return postings.select("fps").mapInArrow(run, "a long, b long")


def fingerprint_links(distinct: DataFrame, posting: int = POSTING) -> DataFrame:
    """(a, b) links that connect just the fingerprints (``fp``, distinct) within RADIUS bits.

    Inverted index: a posting holds the fingerprints with the same bytes at four positions. Its
    members are tallied pair by pair in one task if they are few; a larger posting is first split
    by more bits, in which no pair within RADIUS can be lost.
    """
    levels = index_masks()
    open_ = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(levels[0]) - 1))).alias("mask"))
    out = None
    for n, masks in enumerate(levels):
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        open_ = open_.select("fp", "mask", F.col("fp").bitwiseAND(table[F.col("mask")]).alias("part"))
        sizes = saved(open_.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"))
        final = n == len(levels) - 1
        few = sizes if final else sizes.where(F.col("n") <= posting)
        postings = open_.join(small(few.select("mask", "part")), ["mask", "part"]).groupBy("mask", "part").agg(F.collect_list("fp").alias("fps"))
        links = _links(postings)
        out = links if out is None else out.union(links)
        if final:
            break
        large = sizes.where(F.col("n") > posting)
        if large.isEmpty():
            break
        open_ = saved(
            open_.join(small(large.select("mask", "part")), ["mask", "part"])
            .select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.col("mask") * 4 + j)).alias("mask"))
        )
    return out


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((id, fp) of each row, (fp, component, component_id) of each fingerprint)."""
    rows = saved(fingerprints(docs, key, text))
    classes = saved(rows.groupBy("fp").agg(F.min("id").alias("first")))
    links = saved(fingerprint_links(classes.select("fp")))
    if links.isEmpty():
        return rows, classes.select("fp", F.col("fp").alias("component"), F.col("first").alias("component_id"))
    labels = connected_components(links)
    at = saved(classes.join(small(labels.withColumnRenamed("id", "fp")), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    least = saved(at.groupBy("component").agg(F.min("first").alias("component_id")))
    groups = saved(at.join(small(least), "component").select("fp", "component", "component_id"))
    release(classes, links, at, least)
    return rows, groups


def near_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, fingerprint, component_id) for each row of ``docs``.

    Documents link if their SimHash fingerprints differ in RADIUS bits or fewer; component_id is
    the least ``key`` reachable over links, the document itself included. Null and empty texts have
    fingerprint zero and link as any other. Null keys never are a component's id unless all its
    keys are null. Repeated rows each come out, in one component. An empty table gives no rows;
    other columns are not read. Equal fingerprints are one node, however many documents have them.
    """
    rows, groups = _grouped(docs, key, text)
    return rows.join(small(groups), "fp").select(F.col("id").alias(key), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: one whose ``key`` is its id and whose text is of it.

    Rows of one key may be in several components, each of which keeps its own. A component of null keys only
    keeps one of its rows. All columns are kept as they are.
    """
    rows, groups = _grouped(docs, key, text)
    ident, n, stands, mark, own, component, first = (free_name(c, docs) for c in ("id_", "n_", "stands_", "fp_", "own_", "component_", "first_"))
    keep = saved(
        rows.join(small(groups), "fp").where("id is not null")
        .groupBy(F.col("id").alias(ident)).agg(F.count("*").alias(n), F.max(F.col("id") == F.col("component_id")).alias(stands)).where(F.col(stands))
    )
    stay = docs.join(small(keep), F.col(key) == F.col(ident))
    out = stay.where(F.col(n) == 1).drop(ident, n, stands)
    hashed = F.arrow_udf(_hashed, "long")
    if not keep.where(F.col(n) > 1).isEmpty():  # which of the rows of a key stand is told by their text
        several = stay.where(F.col(n) > 1).drop(n, stands).withColumn(mark, hashed(F.col(text).cast("string")))
        of_fp = groups.select(F.col("fp").alias(own), F.col("component").alias(component), F.col("component_id").alias(first))
        several = several.join(small(of_fp), (F.col(mark) == F.col(own)) & (F.col(ident) == F.col(first)))
        out = out.unionByName(several.dropDuplicates([ident, component]).drop(ident, mark, own, component, first))
    if rows.where("id is null").isEmpty():
        return out
    nameless = docs.where(F.col(key).isNull()).withColumn(mark, hashed(F.col(text).cast("string")))
    alone = groups.where("component_id is null").select(F.col("fp").alias(own), F.col("component").alias(component))
    return out.unionByName(nameless.join(small(alone), F.col(own) == F.col(mark)).dropDuplicates([component]).drop(own, mark, component))
