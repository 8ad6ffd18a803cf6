"""What is known of a problem: volume, trend, sources, evidence and score.

A reaction without a problem is no mention and counts nowhere. One without a time counts in the volume, the sources
and the evidence, and in nothing that goes by time.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.functions import per


@dataclass(frozen=True)
class Weights:
    """Shares of a problem's score; together 1."""

    volume: float = 0.4
    authors: float = 0.2
    sources: float = 0.2
    trend: float = 0.2


def mentions(reactions: DataFrame) -> DataFrame:
    """The reactions that name a problem."""
    return reactions.where("problem_id is not null")


def mention_volume(reactions: DataFrame) -> DataFrame:
    """(problem_id, mentions, authors)."""
    return mentions(reactions).groupBy("problem_id").agg(F.count("*").alias("mentions"), F.countDistinct("author_id").alias("authors"))


def mentions_by_day(reactions: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """(problem_id, day, mentions) for every day from ``first`` to ``last`` (by default those of all mentions with a time), zeros included.
    A problem without a single time has zeros only."""
    rows = mentions(reactions)
    daily = rows.where("ts is not null").groupBy("problem_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("mentions"))
    if first is None or last is None:
        low, high = rows.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
        first, last = first or low, last or high
    if first is None:  # no mention with a time
        return daily
    days = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")
    every = rows.select("problem_id").distinct().select("problem_id", days)
    return every.join(daily, ["problem_id", "day"], "left").select("problem_id", "day", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))


def mention_moving_avg(series: DataFrame, days: int = 7) -> DataFrame:
    """``series`` with ``smooth``: the mean of the last ``days`` days."""
    over = Window.partitionBy("problem_id").orderBy("day").rowsBetween(1 - days, 0)
    return series.withColumn("smooth", F.round(F.avg("mentions").over(over), 6))


def trend_slope(series: DataFrame) -> DataFrame:
    """(problem_id, slope): mentions gained per day, by least squares; null for a single day."""
    at = F.datediff("day", F.lit("1970-01-01").cast("date"))
    return series.groupBy("problem_id").agg((F.round(F.regr_slope(F.col("mentions").cast("double"), at.cast("double")), 6) + F.lit(0.0)).alias("slope"))


def _periods(as_of: str, days: int) -> tuple[Column, Column]:
    """1 for a reaction in the ``days`` before ``as_of``, and in those before, else 0; a null time is in neither."""
    end = dt.datetime.fromisoformat(as_of)
    now, a, b = (F.lit(str(end - dt.timedelta(days=n * days))).cast("timestamp_ntz") for n in (0, 1, 2))
    ts = F.col("ts")
    return F.when((ts >= a) & (ts < now), 1).otherwise(0), F.when((ts >= b) & (ts < a), 1).otherwise(0)


def trend_change(reactions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(problem_id, recent, prior, change): mentions in the ``days`` before ``as_of``, in those before, and (recent - prior) / (recent + prior)."""
    recent, prior = _periods(as_of, days)
    out = mentions(reactions).groupBy("problem_id").agg(F.sum(recent).alias("recent"), F.sum(prior).alias("prior"))
    return out.withColumn("change", F.round(per(F.col("recent") - F.col("prior"), F.col("recent") + F.col("prior")), 6))


def source_distribution(reactions: DataFrame) -> DataFrame:
    """(problem_id, source, mentions, share)."""
    counts = mentions(reactions).groupBy("problem_id", "source").agg(F.count("*").alias("mentions"))
    return counts.withColumn("share", F.round(F.col("mentions") / F.sum("mentions").over(Window.partitionBy("problem_id")), 6))


def _entropy(n: Column, n_ln_n: Column) -> Column:
    return F.round(F.ln(n) - n_ln_n / n, 6)


def source_diversity(dist: DataFrame) -> DataFrame:
    """(problem_id, source_entropy): entropy of the shares in nats, from the counts."""
    total = dist.groupBy("problem_id").agg(F.sum("mentions").alias("n"), F.sum(F.col("mentions") * F.ln("mentions")).alias("s"))
    return total.select("problem_id", _entropy(F.col("n"), F.col("s")).alias("source_entropy"))


def evidence_top_k(docs: DataFrame, k: int = 3) -> DataFrame:
    """(problem_id, doc_id, quality, n_chars, rank): a problem's ``k`` best documents by quality, then length."""
    order = Window.partitionBy("problem_id").orderBy(F.desc("quality"), F.desc("n_chars"), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("problem_id", "doc_id", "quality", "n_chars", F.col("rank").cast("long"))


def problem_measures(reactions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(problem_id, mentions, authors, recent, prior, source_entropy): volume, change and source diversity in one scan.

    Each mention is counted once for its source and once for its author, before it is shuffled; what is shuffled is a row per
    problem and source, and per problem and author.
    """
    recent, prior = _periods(as_of, days)
    rows = mentions(reactions).select("problem_id", "source", "author_id", recent.alias("recent"), prior.alias("prior"))
    sets = [[F.col("problem_id"), F.col("source")], [F.col("problem_id"), F.col("author_id")]]
    counts = rows.groupingSets(sets, "problem_id", "source", "author_id").agg(
        F.grouping("author_id").alias("by_source"), F.count("*").alias("n"), F.sum("recent").alias("recent"), F.sum("prior").alias("prior"),
    )
    of_source = F.col("by_source") == 1

    def total(column: Column) -> Column:
        return F.sum(F.when(of_source, column))

    out = counts.groupBy("problem_id").agg(
        total(F.col("n")).alias("mentions"), F.count(F.when(~of_source, F.col("author_id"))).alias("authors"),
        total(F.col("recent")).alias("recent"), total(F.col("prior")).alias("prior"), total(F.col("n") * F.ln("n")).alias("s"),
    )
    return out.withColumn("source_entropy", _entropy(F.col("mentions"), F.col("s"))).drop("s")


def validation_score(measures: DataFrame, sources: int, weights: Weights = Weights()) -> DataFrame:
    """``measures`` with ``validation_score``, 0 to 100. ``sources``: how many sources there are.
    ``measures`` is read twice, the first time for the largest volume: give a written table."""
    most = measures.agg(F.max("mentions")).first()[0] or 0
    total = F.col("recent") + F.col("prior")
    trend = F.coalesce(0.5 * (1 + per(F.col("recent") - F.col("prior"), total)), F.lit(0.5))
    diversity: Column = F.col("source_entropy") / F.lit(math.log(sources)) if sources > 1 else F.lit(0.0)
    score = (
        weights.volume * F.ln(1 + F.col("mentions")) / F.ln(F.lit(1 + most)) + weights.authors * F.col("authors") / F.col("mentions")
        + weights.sources * diversity + weights.trend * trend
    )
    return measures.withColumn("validation_score", F.round(100 * score, 4))


def problem_list(scores: DataFrame, min_score: float = 60.0, n: int = 20) -> DataFrame:
    """The ``n`` best problems of at least ``min_score``."""
    return scores.where(F.col("validation_score") >= min_score).orderBy(F.desc("validation_score"), "problem_id").limit(n)


def problem_detail(scores: DataFrame, series: DataFrame, dist: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per problem: its measures with ``trend``, ``sources`` and ``evidence`` as sorted arrays of structs."""
    nested = scores
    for name, df, cols in (("trend", series, ["day", "mentions"]), ("sources", dist, ["source", "mentions", "share"]), ("evidence", evidence, ["rank", "doc_id", "quality", "n_chars"])):
        nested = nested.join(df.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name)), "problem_id", "left")
    return nested


#: Registers of a sketch, as a power of two: estimates deviate by 1.04 / sqrt(2^SKETCH_BITS), 1.6 in a hundred, as a standard deviation.
SKETCH_BITS = 12


def author_sketches(reactions: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(problem_id, day, sketch): the authors of each problem and day as a HyperLogLog sketch of bounded size, made before anything is shuffled.

    Sketches of days give those of any period (:func:`authors_of_periods`) without the reactions. A reaction without an author or a time is in none."""
    rows = mentions(reactions).where("author_id is not null and ts is not null")
    return rows.groupBy("problem_id", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("author_id", F.lit(bits)).alias("sketch"))


def authors_of_periods(sketches: DataFrame, period: Column, name: str = "period") -> DataFrame:
    """(problem_id, ``name``, authors): about how many different authors a problem has in each ``period``, an expression over ``day``; merged, not added up."""
    merged = sketches.groupBy("problem_id", period.alias(name)).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("problem_id", name, F.hll_sketch_estimate("sketch").alias("authors"))
