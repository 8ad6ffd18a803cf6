"""From validated problems to ideas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindling.operators.discovery import nearest


def ideas_for_problem(problem_idea: DataFrame, ideas: DataFrame, k: int = 10) -> DataFrame:
    """(problem_id, idea_id, title, category, effort, cost, rank): a problem's ``k`` ideas of least effort, then cost."""
    order = Window.partitionBy("problem_id").orderBy("effort", "cost", "idea_id")
    ranked = problem_idea.join(ideas, "idea_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("problem_id", "idea_id", "title", "category", "effort", "cost", F.col("rank").cast("long"))


def validated_ideas(problem_idea: DataFrame, scores: DataFrame, min_score: float = 60.0) -> DataFrame:
    """The rows of ``problem_idea`` whose problem has at least ``min_score``."""
    good = scores.where(F.col("validation_score") >= min_score).select("problem_id")
    return problem_idea.join(good, "problem_id", "left_semi")


def idea_problem_match(problems: DataFrame, ideas: DataFrame, k: int = 5, problem_key: str = "problem_id", idea_key: str = "idea_id") -> DataFrame:
    """(problem_id, idea_id, cosine, rank): the ``k`` ideas nearest each problem, both given as vectors."""
    near = nearest(ideas, idea_key, problems, problem_key, k).withColumn("cosine", F.round("cosine", 6))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "row")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("problem_id"), F.col("row").alias("idea_id"), "cosine", F.col("rank").cast("long"))


def idea_detail(ideas: DataFrame, problem_idea: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per idea: ``problems``, its problems with their scores, best first, and ``evidence``, their documents."""
    proof = evidence.groupBy("problem_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    linked = problem_idea.join(scores.select("problem_id", "validation_score"), "problem_id").join(proof, "problem_id", "left")
    entry = F.struct((-F.col("validation_score")).alias("order"), "problem_id", "validation_score", F.coalesce("docs", F.array().cast("array<bigint>")).alias("docs"))
    per_idea = linked.groupBy("idea_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    out = ideas.join(per_idea, "idea_id", "left").withColumn("entries", F.coalesce("entries", F.array().cast(per_idea.schema["entries"].dataType)))
    problems = F.transform("entries", lambda x: F.struct(x["problem_id"].alias("problem_id"), x["validation_score"].alias("validation_score")))
    docs = F.flatten(F.transform("entries", lambda x: x["docs"]))
    return out.withColumn("problems", problems).withColumn("evidence", docs).drop("entries")


def unproven_ideas(ideas: DataFrame, problem_idea: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rows of ``ideas`` none of whose problems has a row in ``evidence``.

    An anti join over what exists, not over a list: a null among the problems of the evidence or of an idea proves nothing and hides nothing, and an idea
    with a null id or without any problem is unproven. Ideas meet the ids of the proven ones, one for each."""
    proven = problem_idea.join(evidence.select("problem_id").distinct(), "problem_id", "left_semi").select("idea_id").distinct()
    return ideas.join(proven, "idea_id", "left_anti")
