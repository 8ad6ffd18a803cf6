"""What makers have saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def favorite_state(log: DataFrame) -> DataFrame:
    """(maker_id, item_kind, item_id, ts): what is saved now. The last action counts; of equal ones unsave.

    A maximum per item, pre-aggregated: a much-saved item's log is not gathered."""
    last = log.groupBy("maker_id", "item_kind", "item_id").agg(F.max(F.struct("ts", "seq1", "seq2", "action")).alias("last"))
    return last.where("last.action = 'save'").select("maker_id", "item_kind", "item_id", F.col("last.ts").alias("ts"))


def my_page(state: DataFrame, scores: DataFrame, ideas: DataFrame) -> DataFrame:
    """(maker_id, item_kind, item_id, ts, title, validation_score): saved problems with their score, ideas with their title, newest first."""
    problems = state.where("item_kind = 'problem'").join(scores.select(F.col("problem_id").cast("long").alias("item_id"), "validation_score"), "item_id")
    saved = state.where("item_kind = 'idea'").join(ideas.select(F.col("idea_id").alias("item_id"), "title"), "item_id")
    both = problems.unionByName(saved, allowMissingColumns=True)
    columns = ["maker_id", "item_kind", "item_id", "ts", "title", "validation_score"]
    return both.select(*columns).orderBy("maker_id", F.desc("ts"), "item_kind", "item_id")
