"""A corpus made ready for training: STAGES in order, each on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``, and any more that ``docs``
has, whatever their names. An empty table gives an empty table of those columns. Null texts count as empty ones, except
that they stay null; other columns may be null and are carried along. No stage needs ``doc_id`` to be there or to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.llm import decontaminate, lines, packing, simhash, toxicity
from kindling.llm.common import free_name
from kindling.storage import saved, scratch


def columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` by name, also names with dots or backticks."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from ``labels`` as op1 does.

    Null and empty texts hold no toxic word and stay, unless most labels are toxic. Equal texts share their verdict, also repeated rows. A score at the
    threshold rejects. Null labels teach nothing; without labels of both classes nothing is rejected that their share does not reject.
    """
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name("toxicity", docs)
    scored = toxicity.score_toxicity(docs, model, column=score)
    return scored.where(F.col(f"{score}.score") < toxicity.THRESHOLD).select(*columns(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that stand earlier in the corpus; n_chars follows.

    All rows stay: one that loses all lines has an empty text, a null text stays null (n_chars null). Of equal lines, in one text or
    several, the first by doc_id (null first), line number and a hash of the text stays; repeated rows share their decisions.
    """
    dropped = free_name("dropped", docs)
    out = lines.dedup_lines(docs, column=dropped).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of least doc_id.

    Null, empty and wordless texts are one component. Of repeated rows one stays. Unlike texts under one doc_id are judged apart. Null ids
    come last; a component of null ids only keeps one of its rows.
    """
    return simhash.keep_one(docs).select(*columns(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, items without words are held by none; repeated rows share their verdict. An empty benchmark keeps all.
    """
    held = free_name("contamination", docs)
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), column=held)
    return found.where(F.size(held) == 0).select(*columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, dealt to training sequences.

    A null, empty or blank text is one row without a sequence; repeated rows and null ids are packed like any other; equal rows in any order.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the model of the first stage nor what follows from it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = saved(stage(spark, docs, sf_dir), outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
