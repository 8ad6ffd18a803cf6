"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path). A rule holds for its host and all subdomains, for paths that begin with its path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hex digits of a digest that the first lookup uses.
PREFIX_DIGITS = 8
#: Rules up to this many are sent to all tasks; beyond it the lookup is a shuffled join.
MAX_BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    df = spark.createDataFrame([(v, h, p, f"{h}{p}") for v, h, p in dict.fromkeys(rules)], "verdict string, host string, path string, rule string")
    digest = F.sha2(F.col("rule"), 256)
    return df.select(
        F.col("verdict").alias("r_verdict"), "rule", digest.alias("digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("short"),
        F.length("host").alias("host_length"), F.length("path").alias("path_length"),
    )


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url: str = "url", key: str = "page_id", default: str = "allow",
) -> DataFrame:
    """(``key``, host, path, rule, verdict) for each row of ``pages``.

    A url stands for every host suffix at a dot (the host itself too) joined with every path
    prefix that a rule may have: those of lengths that occur among the rules, so that long hosts and paths cost no more than the rules ask for. These
    expressions meet the rules by the first hex digits of their digests; the full digest then
    decides, the longest rule wins (longer host first among equals, then block before allow).
    No rule: rule null and ``default``. Null or broken urls have empty host and path, which
    only a rule of both empty could fit. Repeated rows are each judged; an empty table gives no rows;
    other columns of ``pages`` are not read, whatever their names.
    """
    spark = pages.sparkSession
    rules = RULES if rules is None else rules
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in rules})])
    tails = F.array(*[F.lit(n) for n in sorted({len(h) for _, h, _ in rules})])
    n_host = F.length("host")
    at_dot = F.filter(tails, lambda n: (n == n_host) | ((n < n_host) & (F.substring(F.col("host"), n_host - n, F.lit(1)) == ".")))
    suffixes = F.transform(at_dot, lambda n: F.substring(F.col("host"), n_host - n + 1, n))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    asked = (
        rows.select("host", "path").distinct()
        .select("host", "path", F.explode(expressions).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("full"))
        .select("host", "path", "full", F.substring("full", 1, PREFIX_DIGITS).alias("short"))
    )
    table = _rules(spark, rules)
    hit = (
        asked.join(F.broadcast(table) if len(rules) <= MAX_BROADCAST_RULES else table, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", (F.col("r_verdict") == "block").alias("blocks"), "rule", "r_verdict")).alias("best"))
    )
    hit = hit.select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.r_verdict")
    return (
        rows.join(hit, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
        .select(key, "host", "path", "rule", F.coalesce("r_verdict", F.lit(default)).alias("verdict"))
    )
