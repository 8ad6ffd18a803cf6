"""The registered queries of the text operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.llm import decontaminate, grid_join, interactions, lines, packing, pages, quality, secrets, simhash, syncmers, toxicity, urls, whitening
from kindling.llm.common import in_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fold, score, verdict, and the toxic spans as start:end, comma-joined."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.fit_toxicity(docs, labels))
    return out.select(
        "doc_id", in_fold("doc_id", 4, 2).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.transform("toxicity.spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score_quality(docs.select("doc_id", "text"), quality.fit_quality(docs, labels))
    return out.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that stay, the numbers of those that go, and the digest of the text that is left."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents").withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")))
    gone = F.coalesce(F.size("dropped_lines"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_lines", (F.col("n_lines") - gone).alias("n_kept"),
        F.coalesce(F.array_join("dropped_lines", ","), F.lit("")).alias("dropped"), F.sha2("text", 256).alias("kept_sha256"),
    )


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    out = pages.extract_text(rows.select("page_id", "url", "html"), pages.fit_pages(rows))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it holds a benchmark item, which ones, and the best similarity."""
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = F.col("contamination")
    return out.select(
        "doc_id", (F.size(found) > 0).alias("contaminated"), F.transform(found, lambda x: x["item"]).alias("item_ids"),
        F.round(F.array_max(F.transform(found, lambda x: x["similarity"])), 6).alias("similarity"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity, op2_quality, op3_line_dedup, op4_syncmers, op5_html, op6_simhash, op7_decontamination, op8_secrets, op9_urls, op10_packing,
        op11_interactions, op12_embeddings, op13_whitening,
    )
    return {f.__name__: f for f in own}


_URLS = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
ranked AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
"""


#: By definition: every order applied to every group of documents that fail alike, Shapley values as sums over the orders.
_INTERACTIONS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS failed
  FROM words LEFT JOIN known USING (doc_id)),
alike AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, letters WHERE length(o) < 5 AND strpos(o, l) = 0),
steps AS (SELECT o AS filter_order, CAST(s AS INT) AS step, substr(o, CAST(s AS INT), 1) AS own, substr(o, 1, CAST(s AS INT) - 1) AS earlier FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
told AS (
  SELECT part, filter_order, step, own, n, good, toxic, strpos(failed, own) > 0 AS hit, failed = own AS alone,
    strpos(earlier, substr(failed, 1, 1)) > 0 AND length(failed) > 0 OR strpos(earlier, substr(failed, 2, 1)) > 0 AND length(failed) > 1 OR strpos(earlier, substr(failed, 3, 1)) > 0 AND length(failed) > 2
    OR strpos(earlier, substr(failed, 4, 1)) > 0 AND length(failed) > 3 OR strpos(earlier, substr(failed, 5, 1)) > 0 AND length(failed) > 4 AS gone
  FROM alike, steps),
summed AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN gone OR hit THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM told GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""

#: All pairs, and what they reach.
_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_embeddings": _EMBEDDINGS, "op11_interactions": _INTERACTIONS, "op9_urls": _URLS.format(rules=", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES))}
