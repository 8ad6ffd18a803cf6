"""The same measures over reactions that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mention_counts(reactions: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """(problem_id, source, day_start, mentions) per window of ``every``; reactions more than ``late`` behind the newest are left out.

    ``reactions`` is a stream (or a table) with ``ts``. State: one counter per open window, problem and source,
    so that a hot problem is counted before it is shuffled.
    """
    timed = reactions.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", every).alias("w"), "problem_id", "source").agg(F.count("*").alias("mentions"))
    return counts.select("problem_id", "source", F.col("w.start").alias("day_start"), "mentions")


def problem_volume(reactions: DataFrame, late: str, every: str = "1 day") -> DataFrame:
    """(problem_id, day_start, mentions) per window of ``every``, without the reactions that arrive again or more than ``late`` behind the newest.

    A reaction is told by its ``reaction_id``: of those that arrive within ``late`` of each other the first counts, whatever file or feed brings
    the others. Reactions without a problem, a time or an id count nowhere. State: the ids of the last ``late``, dealt by id, and a counter per open
    window and problem, which is added up before it is shuffled, so that neither grows with a problem's volume alone or with the stream's length.
    """
    known = reactions.where("problem_id is not null and ts is not null and reaction_id is not null")
    timed = known.select("reaction_id", "problem_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    once = timed.dropDuplicatesWithinWatermark(["reaction_id"])
    counts = once.groupBy(F.window("at", every).alias("w"), "problem_id").agg(F.count("*").alias("mentions"))
    return counts.select("problem_id", F.col("w.start").cast("timestamp_ntz").alias("day_start"), "mentions")


def write_mentions(counts: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Append finished windows to ``folder``, exactly once; ``once``: what is there now, then stop."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
