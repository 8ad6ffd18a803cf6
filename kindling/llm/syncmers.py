"""Document fingerprints: closed syncmers over words, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.llm.common import let, small
from kindling.storage import release, saved

#: Words in a k-mer, words in an inner s-mer.
K, S = 8, 2
#: Rows of a block, within which rows are put in order, on average and at most; stretches of keys that are cut into blocks.
BLOCK_ROWS, MOST_ROWS, STRETCHES = 128, 1024, 64
#: Blocks in a block of the next level, where the order goes on from block to block.
BLOCK_BLOCKS = 4096
#: A word, at most so many characters long; longer runs are cut, and each CJK sign is a word.
WORD = r"[぀-ヿ㐀-鿿]|[^\s぀-ヿ㐀-鿿]{1,24}"


#: An anchor: the hash of its k-mer, and the number of its first word in the text, from 0.
ANCHORS = "array<struct<hash:bigint,at:int>>"


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of ``text``, in text order: array of (hash, at).

    A k-mer of words is one if the least hash of its k-s+1 inner s-mers is at its first or last
    place. Whether it is depends on the k-mer alone, so that equal passages give equal anchors
    wherever they stand. Where none is (it may be so up to about k + (k-s) words), the k-mer of least hash
    is the only anchor. A text of fewer than k words is one k-mer; no words: empty array.
    """
    w = k - s + 1

    def anchor(hash_: Column, at: Column) -> Column:
        return F.struct(hash_.alias("hash"), at.cast("int").alias("at"))

    def chosen(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(words) - F.lit(k - 1))
        inner = F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(s - 1)), lambda i: F.xxhash64(*[words[i + (j - 1)] for j in range(s)]))

        def pick(m: Column) -> Column:
            def kmer(i: Column) -> Column:
                return anchor(F.xxhash64(*[m[i + (j - 1)] for j in range(w)]), i - 1)

            least = F.filter(at, lambda i: let(F.array_min(F.slice(m, i, w)), lambda x: (x == m[i - 1]) | (x == m[i + (w - 2)])))
            return let(F.transform(least, kmer), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.array_min(F.transform(at, kmer)))))

        alone = F.array(anchor(F.xxhash64(F.array_join(words, " ")), F.lit(0)))
        return F.when(F.size(words) >= k, let(inner, pick)).when(F.size(words) > 0, alone).otherwise(F.array().cast(ANCHORS))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), chosen)


def fingerprint_text(anchors: Column) -> Column:
    """The anchors' hashes as 16 hex digits each, comma-joined, in text order."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x["hash"])), 16, "0")), ",")


def placed(anchors: Column) -> Column:
    """A hash of each anchor with its distance in words from the anchor before it (0 for the first): array of long.
    A passage has the same ones wherever it stands; other anchors that happen to be the same seldom have."""
    before = lambda a, x, i: F.when(i > 0, a[F.greatest(i - 1, F.lit(0))]["at"]).otherwise(x["at"])
    return let(anchors, lambda a: F.transform(a, lambda x, i: F.xxhash64(x["hash"], x["at"] - before(a, x, i))))


def likeness(a: Column, b: Column) -> Column:
    """Positional matching of two texts' anchors, 0 to 1: Jaccard of :func:`placed`, in which an anchor matches with its distance to the
    one before it. Two texts without anchors are alike (1)."""

    def jaccard(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        total = F.size(F.array_distinct(x["a"])) + F.size(F.array_distinct(x["b"])) - both
        return F.when(total == 0, F.lit(1.0)).otherwise(both.cast("double") / total)

    return let(F.struct(placed(a).alias("a"), placed(b).alias("b")), jaccard)


def _block(rows: DataFrame, key: str) -> Column:
    """Two numbers that do not fall as ``key`` rises, shared by about BLOCK_ROWS rows if keys are even.

    Quantiles of the keys cut them into STRETCHES of about as many rows; each stretch is cut
    evenly. What reaches the driver is one number per stretch.
    """
    shares = [i / STRETCHES for i in range(STRETCHES + 1)]
    cuts, n = rows.agg(F.percentile_approx(key, shares, 20_000), F.count("*")).first()
    cuts = sorted(set(cuts or [0]))
    each = max(1, n // (max(1, len(cuts) - 1) * BLOCK_ROWS))
    widths = [float(max(1, (b - a) // each)) for a, b in zip(cuts, cuts[1:])] + [float(1 << 62)]
    at = F.greatest(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))), F.lit(1)) - 1
    low, width = F.array(*[F.lit(c) for c in cuts])[at], F.array(*[F.lit(w) for w in widths])[at]
    # As doubles: keys may be further apart than a long can say.
    inner = F.floor(F.least(F.greatest((F.col(key).cast("double") - low.cast("double")) / width, F.lit(0.0)), F.lit(float((1 << 40) - 1))))
    return F.array(at.cast("long"), inner.cast("long"))


def in_blocks(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``block``, a written table of the blocks: (block, n, lo, hi)).

    ``block`` is an array of numbers that does not fall as ``key`` rises, nor, for one key, as ``tie`` falls. However the keys lie, at most
    MOST_ROWS rows share it; more only if they are equal in both. A block of too many rows is cut at quantiles of its
    keys, one of a single key at quantiles of its ties, and so on until none is left. The cuts join as a table that is small; no row moves.
    """
    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    rows = rows.withColumn("block", _block(rows.select(key), key))
    while True:
        sizes = saved(rows.groupBy("block").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")))
        over = sizes.where(F.col("n") > MOST_ROWS)
        if over.isEmpty():
            return rows, sizes
        within = lambda blocks, by: rows.join(small(blocks.select("block")), "block", "left_semi").groupBy("block").agg(
            F.min(by).alias("least"), F.max(by).alias("most"), F.percentile_approx(by, shares, 2_000).alias("q"),
        ).where("least < most")
        several, one = (within(over.where(x), by).withColumn("single", F.lit(by != key)) for x, by in (("lo < hi", key), ("lo = hi", "tie")))
        # The number after a quantile is a cut too: what many rows have gets a block of its own. The least number is none.
        cuts = F.concat("q", F.transform("q", lambda x: F.when(x < F.col("most"), x + 1).otherwise(x)))
        cuts = F.filter(F.array_distinct(F.concat(cuts, F.array("most"))), lambda x: x > F.col("least"))
        cuts = saved(several.union(one).select(F.col("block").alias("whole"), "single", cuts.alias("cuts")))
        if cuts.isEmpty():
            return rows, sizes
        release(sizes)
        rows = rows.join(small(cuts, F.size("cuts")), F.col("block") == F.col("whole"), "left")
        value = F.when(F.col("single"), F.col("tie")).otherwise(F.col(key))
        above = F.size(F.filter("cuts", lambda x: x <= value)).cast("long")
        finer = F.concat("block", F.array(F.when(F.col("single"), -above).otherwise(above)))
        rows = rows.withColumn("block", F.when(F.col("whole").isNull(), F.col("block")).otherwise(finer)).drop("whole", "single", "cuts")


def with_next(rows: DataFrame, key: str, carry: list[str], derive: dict[str, Column]) -> DataFrame:
    """``rows`` with ``next_*`` of each column in ``carry``: the row that follows by descending
    ``key`` (a long, not null), then by ``tie``; the first row after the last. ``derive``: columns to
    add, and to carry, that are made after rows have moved to their block, so that they do not move.

    Rows are ordered inside blocks of adjacent keys; the last row of a block takes the first row
    of the block below, found on one small row per block, itself in blocks.
    """
    rows, sizes = in_blocks(rows, key)
    heads = sizes.select("block", F.col("hi").alias(key))
    there = rows.join(small(heads), ["block", key]).select("block", F.struct("tie", *carry).alias("row"))
    firsts = there.groupBy("block").agg(F.min("row").alias("row")).select("block", *[F.col(f"row.{c}").alias(c) for c in carry])
    carry = [*carry, *derive]
    entry = F.struct(*[F.col(c).alias(c) for c in carry])
    firsts = firsts.withColumns(derive).select("block", entry.alias("first"))
    names = heads.select("block", F.array(F.col("block")[0], F.floor(F.col("block")[1] / F.lit(BLOCK_BLOCKS))).alias("upper"))
    tops = names.groupBy("upper").agg(F.max("block").alias("top"))
    chain = Window.orderBy(F.col("upper").desc())  # one row for each half million documents
    tops = tops.select("upper", F.coalesce(F.lead("top").over(chain), F.first("top").over(chain.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    steps = (
        names.withColumn("below", F.lead("block").over(Window.partitionBy("upper").orderBy(F.col("block").desc())))
        .join(tops, "upper")
        .select(F.col("block").alias("at"), F.coalesce("below", "after").alias("block"))
    )
    bridge = steps.join(firsts.hint("merge"), "block").select(F.col("at").alias("block"), "first")
    inside = Window.partitionBy("block").orderBy(F.col(key).desc(), F.col("tie"))
    rows = rows.repartition("block").withColumns(derive)
    joined = (
        rows.withColumn("following", F.lead(entry).over(inside))
        .join(bridge.hint("merge"), "block")
        .withColumn("following", F.coalesce("following", "first"))
    )
    return joined.select(*[c for c in rows.columns if c != "block"], *[F.col(f"following.{c}").alias(f"next_{c}") for c in carry])


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every whole text and of an edited copy of it, and how alike they are.

    Edited: the last floor(n_chars / 3) code points give way to the first as many (or all) of the
    next document by descending ``key``; after the last comes the first (a lone document follows
    itself). Returns ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, positions (of the anchors of the fingerprint: numbers of words from 0, comma-joined). A null text is empty: n_chars 0, empty fingerprint, alike to another empty one.
    Null keys come last; equal keys are ordered by a hash of the text, equal rows in any order,
    which changes no value (they stand in one block, however many). An empty table gives no rows; other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("rank"), body.alias("body"))
    rows = rows.select("id", "rank", F.xxhash64("body").alias("tie"), "body")
    rows = with_next(rows, "rank", ["body"], {"anchors": syncmers(F.col("body"), k, s)})
    n = F.length("body")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - m), F.substring(F.col("next_body"), F.lit(1), m))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    rows = rows.select("id", "n_chars", "anchors", "next_anchors", F.sha2("edited", 256).alias("edited_sha256"), syncmers(F.col("edited"), k, s).alias("edited_anchors"))
    return rows.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", fingerprint_text(F.col("anchors")).alias("fingerprint"),
        fingerprint_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
        F.array_join(F.transform("anchors", lambda x: x["at"].cast("string")), ",").alias("positions"),
    )
