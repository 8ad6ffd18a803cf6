"""Reading collected reactions and writing the tables that pages read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.storage import delete, saved

#: Canonical reaction columns.
REACTION = "reaction_id bigint, ts timestamp_ntz, author_id bigint, source string, problem_id int, weight double, text string"


@dataclass(frozen=True)
class Feed:
    """One kind of collected reactions: where they lie and what their columns mean.

    ``columns``: canonical column -> SQL expression over the table; others are null. ``url``: column whose site is the
    source. ``where``: rows that are reactions. ``schema``: needed for JSON and CSV.
    """

    path: str
    columns: Mapping[str, str] = field(default_factory=dict)
    url: str | None = None
    where: str | None = None
    schema: str | None = None


def site(url: Column) -> Column:
    """Host of an http(s) url in lower case, without user and port; null where there is none."""
    host = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#@]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def source_from_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``source``: the site its ``url`` names. Null or broken urls have a null source."""
    return df.withColumn("source", site(F.col(url)))


#: Column that holds a line which does not fit its schema.
_MISFIT = "__misfit"


def _lines(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """A JSON or CSV table with _MISFIT. Every column is parsed whichever are asked for, so that a line fits or not, whatever a query selects."""
    wanted = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(_MISFIT, T.StringType())])
    if kind == "csv":
        reader = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _MISFIT)
        # Spark parses the columns that are used, so that the verdict on a line uses all of them.
        rows = reader.option("header", "true").csv(path)
        return rows.withColumn(_MISFIT, F.when(F.pmod(F.hash(*[F.col(f"`{c}`") for c in rows.columns if c != _MISFIT]), F.lit(2)) >= 0, F.col(_MISFIT)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MISFIT}
    return spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", wanted, options).alias("x")).select("x.*")


def _kind(path: str) -> str:
    return next((k for k in ("json", "csv", "orc") if path.rstrip("/").endswith(f".{k}")), "parquet")


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet, ORC, JSON (lines) or CSV table by the ending of its path; text formats need ``schema``, and :func:`misfits` gives their lines that do not fit it."""
    kind = _kind(path)
    if kind in ("json", "csv"):
        if schema is None:
            raise ValueError(f"{path}: a {kind} table needs a schema")
        return _lines(spark, path, schema, kind).where(F.col(_MISFIT).isNull()).drop(_MISFIT)
    return (spark.read if schema is None else spark.read.schema(schema)).format(kind).load(path)


def misfits(spark: SparkSession, inputs: Mapping[str, str | Feed]) -> DataFrame:
    """(kind, path, line) of the lines of JSON and CSV ``inputs`` that :func:`ingest_reactions` cannot read: to be kept, counted and repaired. Other formats have none."""
    out = spark.createDataFrame([], "kind string, path string, line string")
    for name, feed in inputs.items():
        feed = Feed(feed) if isinstance(feed, str) else feed
        if _kind(feed.path) in ("json", "csv") and feed.schema is not None:
            bad = _lines(spark, feed.path, feed.schema, _kind(feed.path)).where(F.col(_MISFIT).isNotNull())
            out = out.union(bad.select(F.lit(name), F.lit(feed.path), F.col(_MISFIT)))
    return out


def ingest_reactions(spark: SparkSession, inputs: Mapping[str, str | Feed]) -> DataFrame:
    """All ``inputs`` (kind -> path or :class:`Feed`) as one table of the canonical columns.

    ``source`` is the site of the feed's ``url``, else what its ``columns`` say, else the kind; a path alone names a table whose columns are
    canonical already. What a table lacks is null, other columns go. Nothing is shuffled, and of Parquet and ORC only the columns that are asked
    for are read. Lines that do not fit their schema are in :func:`misfits`.
    """
    wanted = [x.strip().split(" ", 1) for x in REACTION.split(",")]
    out = None
    for kind, feed in inputs.items():
        feed = Feed(feed) if isinstance(feed, str) else feed
        df = read_any(spark, feed.path, feed.schema)
        df = df.where(feed.where) if feed.where else df
        given = feed.columns or {c: c for c, _ in wanted if c in df.columns}
        cells = {c: F.expr(e) for c, e in given.items()} | ({"source": site(F.col(feed.url))} if feed.url else {})
        df = df.select(*[cells.get(c, F.lit(kind if c == "source" else None)).cast(t).alias(c) for c, t in wanted])
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no inputs to ingest")
    return out


def _write(df: DataFrame, path: str, by: list[str], mode: str = "static") -> None:
    """Few files of even size: rows of a partition are brought together, and split again where a partition is large."""
    rows = df.hint("rebalance", *by) if by else df.hint("rebalance")
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(path)


def publish_tables(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Write each table under ``folder`` as Parquet, replacing what is there; returns their paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        _write(df, paths[name], (partition_by or {}).get(name, []))
    return paths


def published_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The columns of ``new`` and ``change``, "removed" or "added": the rows by which ``new`` differs from ``old`` as a bag, each as often as it is more or fewer. Nulls equal nulls.

    Columns go by name. Rows are counted by content, added up before they are shuffled; a row that changed is one removed and one added."""
    old = old.select(*[F.col(f"`{c}`") for c in new.columns])
    gone, come = old.exceptAll(new), new.exceptAll(old)
    return gone.withColumn("change", F.lit("removed")).union(come.withColumn("change", F.lit("added")))


def publish_changes(new: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Bring the table at ``path``, published in partitions ``by``, to the content of ``new``; returns the changes (:func:`published_changes`), which are written before.

    Only partitions with a change are written, and those without a row any more are deleted; the files of all others stay as they are. ``new`` must not read ``path``.
    Partitions are told by their columns, a null one too; a column of timestamps or floating numbers is no partition."""
    spark = new.sparkSession
    old = spark.read.schema(new.schema).parquet(path)
    changes = saved(published_changes(old, new))
    touched = saved(changes.select(*by).distinct())

    def same(a: DataFrame, b: DataFrame):
        on = F.lit(True)
        for c in by:
            on = on & a[c].eqNullSafe(b[c])
        return on

    rows = new.join(touched, same(new, touched), "left_semi")
    if not touched.isEmpty():
        _write(rows, path, by, "dynamic")
    left = rows.select(*by).distinct()
    for part in touched.join(left, same(touched, left), "left_anti").toLocalIterator():
        delete(spark, "/".join([path.rstrip("/"), *[f"{c}={'__HIVE_DEFAULT_PARTITION__' if part[c] is None else part[c]}" for c in by]]))
    return changes
