"""Audit of filters that reject the same documents: steps of every order and Shapley values by the Hart-Mas-Colell potential."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import small
from kindling.storage import saved

#: The filters: short, repetitive, shouting, marked up, copied. The last is told across documents.
LETTERS = "ABCDE"
#: Failure limits: words, distinct words a hundred words, capitals a hundred code points.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
#: Bytes of a text whose words are split at once.
PIECE = 1 << 20

_SPACE = re.compile(rb"[ \t-\r]")
_CAPITALS, _MARKS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words) between ASCII white space, case-sensitive. Long texts are split a piece at a time: what is held is the set of distinct words."""
    words, seen, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        piece = text[at:end].split()
        words += len(piece)
        seen.update(piece)
        at = end
    return words, len(seen)


def text_failures(text: bytes) -> int:
    """The bits of the filters A to D that a text, as UTF-8, fails."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    chars = len(text.translate(None, _INNER))
    marked = len(text.translate(None, _MARKS)) < len(text)
    fails = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * words, 100 * capitals > MAX_CAPITALS * chars, marked)
    return sum(1 << i for i, f in enumerate(fails) if f)


def document_failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of each row; bit i of ``mask`` is set if the row fails LETTERS[i].

    Null texts are empty, a null ``part`` is the empty one. A row fails E if a row of lesser ``key`` has the same text, by a 128-bit digest; null
    keys are lesser than none and greater than none, and rows of one key do not fail by each other. Texts are read once and do not
    move: what is shuffled are digests, pre-aggregated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for cell in batch.column(2):
                body = cell.as_py() or b""
                masks.append(text_failures(body))
                digests.append(hashlib.blake2b(body, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])

    kind = docs.schema[key].dataType.simpleString()
    cells = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").cast("binary").alias("body"))
    rows = saved(cells.mapInArrow(run, f"id {kind}, part string, mask int, digest binary"))
    several = saved(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"))
    copied = F.when(F.col("id") > F.col("first"), 1 << (len(LETTERS) - 1)).otherwise(0)
    return rows.join(small(several), "digest", "left").select("id", "part", (F.col("mask") + copied).alias("mask"))


def label_counts(fails: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail the same filters, those of quality 1, those that are toxic.

    Several labels of one id: the largest; null ids have none. At most 2^filters rows a part leave the first aggregation of a task.
    """
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    joined = fails.join(known.where("good = 1 or toxic = 1"), "id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of ``counts`` (part, mask, n, good, toxic): a row for each part, order of the filters and step.

    A coalition S of filters removes v(S) documents: those that fail one of it. Its potential is P(S) = (v(S) + sum of P(S without i)
    over its filters) / |S|, P of none 0; a filter's Shapley value is P(all) - P(all without it). Potentials are held times k!, which
    makes them whole, and coalitions go by number, so that a coalition comes after its parts. What a step removes is the difference of the two
    coalitions that it stands between. A part's at most 2^k rows meet in one row; parts are dealt by Spark, however many.
    """
    k = len(letters)
    full = (1 << k) - 1
    orders = []  # a filter's place among the letters is its bit
    for order in permutations(letters):
        prefix = [0]
        for letter in order:
            prefix.append(prefix[-1] | 1 << letters.index(letter))
        orders.append(f"struct('{''.join(order)}' as name, array({', '.join(map(str, prefix))}) as prefix)")
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def left(what: str) -> Column:
        """What each coalition leaves, by its number."""
        return F.expr(f"transform(sequence(0, {full}), s -> aggregate(cells, 0L, (sum, x) -> sum + if((x.mask & s) = 0, x.{what}, 0L)))")

    known = cells.select("part", left("n").alias("kept"), left("good").alias("good"), left("toxic").alias("toxic"))
    potential = F.expr(
        f"""aggregate(sequence(1, {full}), array(0L), (p, s) -> concat(p, array((
            {factorial(k)}L * (kept[0] - kept[s]) + aggregate(sequence(0, {k - 1}), 0L, (sum, i) -> sum + if((s & shiftleft(1, i)) != 0, p[s - shiftleft(1, i)], 0L))
        ) div bit_count(s))))"""
    )
    steps = known.withColumn("potential", potential).select("*", F.expr(f"explode(array({', '.join(orders)}))").alias("o")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    steps = steps.withColumn("before", F.expr("o.prefix[step - 1]")).withColumn("after", F.expr("o.prefix[step]")).withColumn("own", F.expr("after - before"))
    return steps.selectExpr(
        "part", "o.name as filter_order", "step", "kept[after] as kept", "kept[before] - kept[after] as removed",
        "(kept[0] - kept[own]) - (kept[before] - kept[after]) as redundant", f"kept[{full} - own] - kept[{full}] as unique_fails",
        "good[before] - good[after] as good_lost", "toxic[before] - toxic[after] as toxic_lost", f"potential[{full}] - potential[{full} - own] as shapley",
    )


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) over whole texts.

    Every row of ``docs`` counts, repeated rows and null keys too; null and empty texts fail A alone (and E, if copied). No documents give no parts; no
    labels give zeros. Other columns are not read, whatever their names.
    """
    return interactions(label_counts(document_failures(docs, key, text, part), labels, key))
