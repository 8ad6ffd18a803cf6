"""The canonical tables, derived from the test tables. Operators never see the names used there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.functions import tokens
from kindling.operators.cleaning import screen_evidence
from kindling.operators.discovery import place_reactions
from kindling.sources import Feed, ingest_reactions

#: End of the last period of the test events.
AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feeds(sf_dir: str) -> dict[str, Feed]:
    """What reactions are made of: events, which name their problem; pages and what users write in conversations, whose text has to."""
    event = {
        "reaction_id": "event_id", "ts": "cast(ts as timestamp_ntz)", "author_id": "user_id", "source": "event_type",
        "problem_id": "cast(get_json_object(props, '$.k') as int)", "weight": "value",
    }
    return {
        "event": Feed(f"{sf_dir}/events.parquet", event),
        "page": Feed(f"{sf_dir}/pages.parquet", {"reaction_id": "page_id", "text": "regexp_replace(html, '<[^>]*>', ' ')"}, url="url"),
        "conversation": Feed(f"{sf_dir}/conversations.parquet", {"reaction_id": "conv_id", "text": "text"}, where="role = 'user'"),
    }


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_reactions(spark, {"event": feeds(sf_dir)["event"]}).drop("text")


#: Days of events that arrive together, and how far behind the newest a reaction may be to count.
ARRIVAL_DAYS, LATE = 5, "12 days"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactions with the ``batch`` that they arrive in, events of ARRIVAL_DAYS at a time: every eleventh one batch late, every fifth again in the batch after, and every
    thirteenth of the first two days not until the sixth batch, when it is more than LATE behind."""
    rows = reactions(spark, sf_dir)
    own = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / ARRIVAL_DAYS).cast("int")
    lost = (F.col("reaction_id") % 13 == 0) & (F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"))
    batch = F.when(lost, F.lit(5)).otherwise(own + F.when(F.col("reaction_id") % 11 == 0, 1).otherwise(0))
    again = F.when(F.col("reaction_id") % 5 == 0, F.array(batch, batch + 1)).otherwise(F.array(batch))
    return rows.withColumn("batch", F.explode(again))


def all_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactions of every feed, with the problem that their text names where they have none."""
    return place_reactions(ingest_reactions(spark, feeds(sf_dir)), lexicon(spark, sf_dir)).drop("text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("problem_id", (F.col("doc_id") % 100).cast("int"))


def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen_evidence(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark items as terms of problem item_id % 100: those that name one problem and no other."""
    words = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 100).cast("int").alias("problem_id"), F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.min("problem_id").alias("problem_id"), F.max("problem_id").alias("last")).where("problem_id = last").select("problem_id", "term")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idea_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"),
        F.col("p_size").alias("effort"), F.col("p_retailprice").alias("cost"),
    )


def problem_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.select((F.col("p_partkey") % 100).cast("int").alias("problem_id"), F.col("p_partkey").alias("idea_id"))
    b = part.select((F.col("p_size") * 2 % 100).cast("int").alias("problem_id"), F.col("p_partkey").alias("idea_id"))
    return a.union(b).distinct()


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.explode(F.sequence(F.col("c_nationkey") * 4, F.col("c_nationkey") * 4 + 2))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("maker_id"), F.col("c_acctbal").alias("budget"), (5 + F.col("c_nationkey")).alias("max_effort"), chosen.alias("problem_id"),
    )


def favorite_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    ideas_ = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").join(orders, "l_orderkey").select(
        F.col("o_custkey").alias("maker_id"), F.lit("idea").alias("item_kind"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("l_returnflag") == "R", "unsave").otherwise("save").alias("action"), F.col("l_orderkey").alias("seq1"), F.col("l_linenumber").cast("long").alias("seq2"),
    )
    problems = reactions(spark, sf_dir).where("source = 'signup' and problem_id is not null").select(
        F.col("author_id").alias("maker_id"), F.lit("problem").alias("item_kind"), F.col("problem_id").cast("long").alias("item_id"), "ts",
        F.lit("save").alias("action"), F.col("reaction_id").alias("seq1"), F.lit(0).cast("long").alias("seq2"),
    )
    return ideas_.union(problems)
