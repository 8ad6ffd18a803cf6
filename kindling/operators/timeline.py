"""Reactions in time: what was known when, periods in which a problem is raised in bursts, and which reactions fall into periods."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.functions import micros
from kindling.operators.measures import mentions
from kindling.storage import saved

#: Periods of one level are up to this many times as long as those of the level below.
LEVEL = 8
#: A day, in microseconds.
DAY = 86_400_000_000
#: How much more often than usual a problem is raised in a burst, what entering one costs (times ln of the days), parts of 1 that costs are counted in.
BURST_RATE, BURST_COST, UNITS = 2.0, 0.5, 1_000_000


def as_of_join(left: DataFrame, right: DataFrame, by: str, on: str, take: list[str], seq: str, count: str | None = None) -> DataFrame:
    """``left`` with the ``take`` columns of the row of ``right`` that is last at the time ``on`` among those of the same ``by``, and ``count``, how many there are by then.

    A row of ``right`` at the very time counts; of several at one time the one of greatest ``seq`` (a long) is last. Rows of ``left`` without ``by`` or
    ``on``, and those before every row of ``right``, get nulls and 0; rows of ``right`` without them match nothing.

    Both sides become one table, range-partitioned by key and time: a partition is a block of time of bounded size, and a hot key has as many blocks as it
    needs, also where all its rows have one time. Rows are carried forward inside blocks; from block to block goes one row per key and block.
    """
    out = set(left.columns) & {*take, *([count] if count else [])}
    if out:
        raise ValueError(f"columns of both sides: {sorted(out)}")
    rows = F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns])
    values = F.struct(*[F.col(f"`{c}`").alias(c) for c in take])
    known = F.col(f"`{by}`").isNotNull() & F.col(f"`{on}`").isNotNull()
    a = right.where(known).select(F.col(f"`{by}`").alias("k"), F.col(f"`{on}`").alias("t"), F.lit(0).alias("side"), F.col(f"`{seq}`").cast("long").alias("seq"), values.alias("r"))
    b = left.where(known).select(F.col(f"`{by}`").alias("k"), F.col(f"`{on}`").alias("t"), F.lit(1).alias("side"), F.monotonically_increasing_id().alias("seq"), rows.alias("l"))
    both = a.unionByName(b, allowMissingColumns=True)
    placed = saved(both.repartitionByRange("k", "t", "side", "seq").withColumn("block", F.spark_partition_id()))

    order = F.struct("t", "seq")
    here = F.col("side") == 0
    ends = placed.groupBy("k", "block").agg(F.max_by("r", F.when(here, order)).alias("r"), F.count(F.when(here, 1)).alias("n"))
    earlier = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("block", "k", F.last("r", ignorenulls=True).over(earlier).alias("before"), F.sum("n").over(earlier).alias("n_before")).where("before is not null")

    inside = Window.partitionBy("block", "k").orderBy("t", "side", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = placed.select("block", "k", "side", "l", F.last("r", ignorenulls=True).over(inside).alias("r"), F.count(F.when(here, 1)).over(inside).alias("n")).where("side = 1")
    found = filled.join(carried, ["block", "k"], "left").select("l", F.coalesce("r", "before").alias("r"), (F.col("n") + F.coalesce("n_before", F.lit(0))).alias("n"))
    number = [F.col("n").alias(count)] if count else []
    matched = found.select("l.*", "r.*", *number)
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take] + ([F.lit(0).cast("long").alias(count)] if count else [])
    return matched.union(left.where(~known).select("*", *nothing))


def score_when_saved(log: DataFrame, reactions: DataFrame) -> DataFrame:
    """(maker_id, problem_id, ts, seq1, seq2, volume, reaction_id, source): at each save of a problem, its running volume and its latest reaction by then.

    Every save counts, also one that was taken back later. A problem that nobody had raised has volume 0 and no reaction."""
    saves = log.where("item_kind = 'problem' and action = 'save'").select("maker_id", F.col("item_id").cast("int").alias("problem_id"), "ts", "seq1", "seq2")
    return as_of_join(saves, mentions(reactions), "problem_id", "ts", ["reaction_id", "source"], "reaction_id", count="volume")


def interval_join(points: DataFrame, intervals: DataFrame, by: str, at: Column, start: Column, end: Column, width: int) -> DataFrame:
    """Each row of ``points`` beside each row of ``intervals`` of the same ``by`` with ``start`` <= ``at`` < ``end`` (longs); ``by`` comes once.

    An equi-join: time is cut into bins, and an interval stands in the bins that it touches at the finest level whose bins are as long as itself, at
    most two. Bins of a level are LEVEL times as long as those of the level below, the lowest has ``width``. A point stands in one bin of each level that
    occurs, and the ends decide. Long intervals cost no more rows than short ones. Nulls match nothing, nor do intervals that end before they start.
    """
    out = (set(points.columns) & set(intervals.columns)) - {by}
    if out:
        raise ValueError(f"columns of both sides: {sorted(out)}")
    sizes = [width]
    while sizes[-1] < 1 << 58:
        sizes.append(sizes[-1] * LEVEL)
    long_ = end - start
    level = sum((F.when(long_ > s, 1).otherwise(0) for s in sizes), F.lit(0))
    # Nothing is longer than the last level but one; a longer one would be beyond the range of times.
    spans = intervals.where(F.col(f"`{by}`").isNotNull() & (start < end)).select(
        F.col(f"`{by}`").alias("k"), F.struct(*[F.col(f"`{c}`").alias(c) for c in intervals.columns if c != by]).alias("i"), start.alias("s"), end.alias("e"), level.alias("level"),
    )
    used = sorted(r["level"] for r in spans.select("level").distinct().collect())
    table = F.array(*[F.lit(s).cast("long") for s in sizes])

    def bin_(x: Column, size: Column) -> Column:
        return x - F.pmod(x, size)

    size = table[F.least("level", F.lit(len(sizes) - 1))]
    bins = F.array_distinct(F.array(bin_(F.col("s"), size), bin_(F.col("e") - 1, size)))
    spans = spans.select("k", "i", "s", "e", "level", F.explode(bins).alias("bin"))
    packed = points.select(F.col(f"`{by}`").alias("k"), at.alias("x"), F.struct(*[F.col(f"`{c}`").alias(c) for c in points.columns]).alias("p")).where("k is not null and x is not null")
    each = [F.struct(F.lit(n).alias("level"), bin_(F.col("x"), F.lit(sizes[min(n, len(sizes) - 1)]).cast("long")).alias("bin")) for n in used]
    none = F.array().cast("array<struct<level:int,bin:bigint>>")
    packed = packed.select("k", "x", "p", F.explode(F.array(*each) if each else none).alias("b")).select("k", "x", "p", "b.level", "b.bin")
    met = packed.join(spans, ["k", "level", "bin"]).where("s <= x and x < e")
    return met.select("p.*", "i.*")


class BurstPath:
    """The cheapest path of one problem through its days, calm or in a burst; gives the bursts on it.

    Rows come by day: costs of either state, and of entering a burst. Leaving one is free, and the day before the first is calm. Of
    equal paths the calmer one counts, from the end backwards. What is kept of a day is its date, mentions, gain and two predecessors.
    """

    def __init__(self) -> None:
        self.key, self.calm, self.burst, self.days = None, 0, None, []

    def eval(self, row) -> None:
        self.key = row["problem_id"]
        burst = row["enter"] if self.burst is None else self.burst
        from_burst, stays = self.calm > burst, self.calm + row["enter"] > burst
        self.days.append((row["day"], row["mentions"], row["calm"] - row["burst"], from_burst, stays))
        self.calm, self.burst = row["calm"] + min(self.calm, burst), row["burst"] + min(self.calm + row["enter"], burst)

    def terminate(self) -> Iterator[tuple]:
        inside, at = bool(self.days) and self.calm > self.burst, len(self.days)
        run, out = [], []
        for at in range(len(self.days) - 1, -1, -1):
            day, n, gain, from_burst, stays = self.days[at]
            if inside:
                run.append((day, n, gain))
            if run and (not inside or not stays or not at):
                out.append(run)
                run = []
            inside = stays if inside else from_burst
        for run in reversed(out):
            yield self.key, run[-1][0], run[0][0], len(run), sum(n for _, n, _ in run), sum(g for _, _, g in run)


def burst_costs(series: DataFrame, rate: float = BURST_RATE, cost: float = BURST_COST) -> DataFrame:
    """(problem_id, day, mentions, calm, burst, enter): what a day costs in either state and what entering a burst costs, in whole UNITS parts of 1.

    A problem's share of a day's mentions is binomial around its share of all mentions, in a burst around ``rate`` times that (at most half-way to 1).
    A problem without mentions, or the only one there is, has no costs and no bursts."""
    days = series.groupBy("day").agg(F.sum("mentions").alias("all"))
    spread = days.agg(F.count("*").alias("days"), F.sum("all").alias("total"))
    share = series.groupBy("problem_id").agg(F.sum("mentions").alias("own")).join(F.broadcast(spread)).where("own > 0 and own < total")  # one row
    share = share.select("problem_id", (F.col("own").cast("double") / F.col("total")).alias("p"), F.round(F.lit(cost) * F.ln("days") * UNITS).cast("long").alias("enter"))
    share = share.withColumn("q", F.least(F.col("p") * rate, (F.col("p") + 1) / 2))
    rows = series.join(days, "day").join(share, "problem_id")

    def costs(p: str) -> Column:
        return F.round(-(F.col("mentions") * F.ln(p) + (F.col("all") - F.col("mentions")) * F.ln(1 - F.col(p))) * UNITS).cast("long")

    return rows.select("problem_id", "day", "mentions", costs("p").alias("calm"), costs("q").alias("burst"), "enter")


def burst_periods(series: DataFrame, rate: float = BURST_RATE, cost: float = BURST_COST) -> DataFrame:
    """(problem_id, burst_start, burst_end, days, mentions, weight): the periods, first and last day, in which a problem is in a burst; ``weight``: how much likelier the burst is, as a logarithm.

    ``series``: daily mentions, zeros included. The two states' cheapest path, found problem by problem over its days in a table function that Spark
    partitions; a task holds the days of one problem."""
    kind = series.schema["problem_id"].dataType.simpleString()
    path = F.udtf(BurstPath, returnType=f"problem_id {kind}, burst_start date, burst_end date, days long, mentions long, gain long")
    out = path(burst_costs(series, rate, cost).asTable().partitionBy("problem_id").orderBy("day"))
    return out.select("problem_id", "burst_start", "burst_end", "days", "mentions", F.round(F.col("gain") / UNITS, 6).alias("weight"))


def mentions_in_bursts(reactions: DataFrame, bursts: DataFrame) -> DataFrame:
    """(reaction_id, problem_id, ts, source, burst_start, burst_end): the reactions that fall into a burst of their problem."""
    rows = mentions(reactions).select("reaction_id", "problem_id", "ts", "source")
    periods = bursts.select("problem_id", "burst_start", "burst_end")
    start, end = micros(F.col("burst_start").cast("timestamp_ntz")), micros(F.date_add("burst_end", 1).cast("timestamp_ntz"))
    return interval_join(rows, periods, "problem_id", micros(F.col("ts")), start, end, DAY)
