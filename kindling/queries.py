"""Registered queries of the library's own operators, and the DuckDB SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.functions import id_list
from kindling.operators import cleaning, discovery, favorites, ideas, measures, personal, timeline, together
from kindling.plans import fixtures as fx
from kindling.sources import ingest_reactions as ingest
from kindling.sources import publish_changes
from kindling.sources import publish_tables as publish
from kindling.sources import source_from_url as from_url
from kindling.storage import fresh_folder, saved
from kindling.streaming import problem_volume, write_mentions

Query = Callable[[SparkSession, str], DataFrame]


def ingest_reactions(s: SparkSession, d: str) -> DataFrame:
    return ingest(s, fx.feeds(d)).drop("text")


def ingested_volume(s: SparkSession, d: str) -> DataFrame:
    return measures.mention_volume(fx.all_reactions(s, d))


def ingested_sources(s: SparkSession, d: str) -> DataFrame:
    """Shares over the sites that pages come from, the kinds of events, and conversations."""
    return measures.source_distribution(fx.all_reactions(s, d))


def source_from_url(s: SparkSession, d: str) -> DataFrame:
    return from_url(fx.table(s, d, "pages").select("page_id", "url"))


def publish_tables(s: SparkSession, d: str) -> DataFrame:
    """The pages' tables written and read back, as one table."""
    at, scores = fresh_folder(s), saved(validation_score(s, d))
    chosen = personal.personalized_ideas(fx.requests(s, d), fx.problem_ideas(s, d), fx.ideas(s, d), scores)
    tables = {"problem_list": measures.problem_list(scores), "ideas_for_problem": ideas_for_problem(s, d), "personalized_ideas": chosen}
    paths = publish(tables, at, {"ideas_for_problem": ["problem_id"]})
    out = None
    for name, path in paths.items():
        rows = s.read.schema(tables[name].schema).parquet(path)
        cells = {"maker_id": "long", "problem_id": "int", "idea_id": "long", "rank": "long", "title": "string", "validation_score": "double", "best_score": "double"}
        rows = rows.select(F.lit(name).alias("table_name"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in cells.items()])
        out = rows if out is None else out.union(rows)
    return out


def normalize_reactions(s: SparkSession, d: str) -> DataFrame:
    out = cleaning.normalize_reactions(fx.table(s, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def dedup_exact(s: SparkSession, d: str) -> DataFrame:
    return cleaning.dedup_exact(fx.table(s, d, "documents"))


def dedup_near(s: SparkSession, d: str) -> DataFrame:
    return cleaning.dedup_near(fx.table(s, d, "documents").select("doc_id", "text"))


def dedup_near_lsh(s: SparkSession, d: str) -> DataFrame:
    return cleaning.dedup_near(fx.table(s, d, "documents").select("doc_id", "text"), method="lsh")


def screen_evidence(s: SparkSession, d: str) -> DataFrame:
    return fx.evidence_documents(s, d).select("doc_id", "problem_id", "source", "quality", "n_chars")


def match_problem_terms(s: SparkSession, d: str) -> DataFrame:
    return discovery.match_problem_terms(fx.table(s, d, "documents").select("doc_id", "text"), fx.lexicon(s, d))


def problem_terms(s: SparkSession, d: str) -> DataFrame:
    return discovery.problem_terms(fx.table(s, d, "documents").select("source", "text"))


def cluster_reactions(s: SparkSession, d: str) -> DataFrame:
    return discovery.cluster_reactions(fx.vectors(s, d))


def assign_problem(s: SparkSession, d: str) -> DataFrame:
    return discovery.assign_problem(fx.vectors(s, d), discovery.centroids(fx.vectors(s, d)))


def mention_volume(s: SparkSession, d: str) -> DataFrame:
    return measures.mention_volume(fx.reactions(s, d))


def mentions_by_day(s: SparkSession, d: str) -> DataFrame:
    return measures.mentions_by_day(fx.reactions(s, d))


def mention_moving_avg(s: SparkSession, d: str) -> DataFrame:
    return measures.mention_moving_avg(mentions_by_day(s, d))


def trend_slope(s: SparkSession, d: str) -> DataFrame:
    return measures.trend_slope(mentions_by_day(s, d))


def trend_change(s: SparkSession, d: str) -> DataFrame:
    return measures.trend_change(fx.reactions(s, d), fx.AS_OF)


def source_distribution(s: SparkSession, d: str) -> DataFrame:
    return measures.source_distribution(fx.reactions(s, d))


def source_diversity(s: SparkSession, d: str) -> DataFrame:
    return measures.source_diversity(source_distribution(s, d))


def evidence_top_k(s: SparkSession, d: str) -> DataFrame:
    return measures.evidence_top_k(screen_evidence(s, d))


def validation_score(s: SparkSession, d: str) -> DataFrame:
    rows = fx.reactions(s, d)
    return measures.validation_score(saved(measures.problem_measures(rows, fx.AS_OF)), measures.mentions(rows).select("source").distinct().count())


def problem_list(s: SparkSession, d: str) -> DataFrame:
    return measures.problem_list(validation_score(s, d))


def problem_detail(s: SparkSession, d: str) -> DataFrame:
    """Flattened: the nested arrays as text."""
    out = measures.problem_detail(validation_score(s, d), mentions_by_day(s, d), source_distribution(s, d), evidence_top_k(s, d))
    return out.select(
        "problem_id", "mentions", "authors", "validation_score",
        id_list(F.transform("trend", lambda x: x["mentions"])).alias("trend"),
        F.array_join(F.transform("sources", lambda x: F.concat(x["source"], F.lit(":"), x["mentions"].cast("string"))), ",").alias("sources"),
        F.coalesce(id_list(F.transform("evidence", lambda x: x["doc_id"])), F.lit("")).alias("evidence"),
    )


def ideas_for_problem(s: SparkSession, d: str) -> DataFrame:
    return ideas.ideas_for_problem(fx.problem_ideas(s, d), fx.ideas(s, d))


def validated_ideas(s: SparkSession, d: str) -> DataFrame:
    return ideas.validated_ideas(fx.problem_ideas(s, d), validation_score(s, d))


def idea_problem_match(s: SparkSession, d: str) -> DataFrame:
    """Problems are the vectors whose id is divisible by 100, ideas are all vectors."""
    rows = fx.vectors(s, d)
    problems = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("problem_id"), "embedding")
    return ideas.idea_problem_match(problems, rows.select(F.col("vec_id").alias("idea_id"), "embedding"))


def idea_detail(s: SparkSession, d: str) -> DataFrame:
    """Flattened: the nested arrays as text."""
    out = ideas.idea_detail(fx.ideas(s, d), fx.problem_ideas(s, d), validation_score(s, d), evidence_top_k(s, d))
    return out.select("idea_id", "title", id_list(F.transform("problems", lambda x: x["problem_id"])).alias("problems"), id_list(F.col("evidence")).alias("evidence"))


def filter_ideas_by_conditions(s: SparkSession, d: str) -> DataFrame:
    return personal.filter_ideas_by_conditions(fx.requests(s, d), fx.problem_ideas(s, d), fx.ideas(s, d))


def combine_problems(s: SparkSession, d: str) -> DataFrame:
    return personal.combine_problems(fx.requests(s, d), fx.problem_ideas(s, d))


def co_mentioned_problems(s: SparkSession, d: str) -> DataFrame:
    return personal.co_mentioned_problems(fx.reactions(s, d))


def personalized_ideas(s: SparkSession, d: str) -> DataFrame:
    return personal.personalized_ideas(fx.requests(s, d), fx.problem_ideas(s, d), fx.ideas(s, d), validation_score(s, d))


def personalized_grounds(s: SparkSession, d: str) -> DataFrame:
    """Flattened: one row per ground."""
    out = personal.personalized_grounds(personalized_ideas(s, d), fx.requests(s, d), fx.problem_ideas(s, d), validation_score(s, d), evidence_top_k(s, d))
    flat = out.select("maker_id", "idea_id", "rank", F.explode("grounds").alias("g"))
    return flat.select("maker_id", "idea_id", "rank", "g.problem_id", "g.validation_score", id_list(F.col("g.docs")).alias("docs"))


def favorite_state(s: SparkSession, d: str) -> DataFrame:
    return favorites.favorite_state(fx.favorite_log(s, d))


def my_page(s: SparkSession, d: str) -> DataFrame:
    return favorites.my_page(favorite_state(s, d), validation_score(s, d), fx.ideas(s, d))


def score_when_saved(s: SparkSession, d: str) -> DataFrame:
    return timeline.score_when_saved(fx.favorite_log(s, d), fx.reactions(s, d))


def burst_periods(s: SparkSession, d: str) -> DataFrame:
    return timeline.burst_periods(mentions_by_day(s, d))


def mentions_in_bursts(s: SparkSession, d: str) -> DataFrame:
    return timeline.mentions_in_bursts(fx.reactions(s, d), saved(burst_periods(s, d)))


def stream_problem_volume(s: SparkSession, d: str) -> DataFrame:
    """Daily volume over a stream that brings the events in batches, some late, some again. Each batch is a run of its own, which goes on from the checkpoint
    of the one before; the last is a heartbeat that closes all days."""
    at = fresh_folder(s)
    rows = saved(fx.arrivals(s, d))
    last = rows.agg(F.max("batch")).first()[0]
    if last is None:
        return s.createDataFrame([], "problem_id int, day date, mentions long")
    columns = rows.drop("batch").schema
    beat = s.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in columns])
    beat = beat.withColumns({"reaction_id": F.lit(-1).cast("long"), "problem_id": F.lit(-1), "ts": F.lit("2030-01-01").cast("timestamp_ntz")})
    for batch in range(last + 2):
        arrived = rows.where(F.col("batch") == batch).drop("batch") if batch <= last else beat
        arrived.write.mode("append").parquet(f"{at}/in")
        stream = s.readStream.schema(columns).parquet(f"{at}/in")
        write_mentions(problem_volume(stream, fx.LATE), f"{at}/out", f"{at}/state").awaitTermination()
    out = s.read.schema("problem_id int, day_start timestamp_ntz, mentions long").parquet(f"{at}/out")
    return out.select("problem_id", F.to_date("day_start").alias("day"), "mentions")


def frequent_sets(s: SparkSession, d: str) -> DataFrame:
    """Sets of problems that one author raised on one day, at least three times."""
    rows = measures.mentions(fx.reactions(s, d)).select("author_id", F.to_date("ts").alias("day"), "problem_id")
    out = together.frequent_sets(rows, ["author_id", "day"], "problem_id")
    return out.select(id_list(F.col("items")).alias("problems"), "n_items", "baskets")


def author_sketches(s: SparkSession, d: str) -> DataFrame:
    """Authors of each problem and week, from the sketches of days."""
    sketches = saved(measures.author_sketches(fx.reactions(s, d)))
    return measures.authors_of_periods(sketches, F.trunc("day", "week"), "week")


def affordable_sets(s: SparkSession, d: str) -> DataFrame:
    out = personal.affordable_sets(fx.requests(s, d), fx.problem_ideas(s, d), fx.ideas(s, d))
    return out.select("maker_id", "covered", "cost", id_list(F.col("ideas")).alias("ideas"))


def phrase_candidates(s: SparkSession, d: str) -> DataFrame:
    return discovery.phrase_candidates(fx.table(s, d, "documents").select("text"))


def unproven_ideas(s: SparkSession, d: str) -> DataFrame:
    """Ideas without a document of good quality for any of their problems."""
    return ideas.unproven_ideas(fx.ideas(s, d), fx.problem_ideas(s, d), fx.evidence_documents(s, d).where("quality = 1"))


def published_changes(s: SparkSession, d: str) -> DataFrame:
    """What reactions that arrived after the fourth batch change in daily mentions, published in a partition for each day: only those days are written again."""
    at, rows = f"{fresh_folder(s)}/mentions", saved(fx.arrivals(s, d))

    def version(arrived: DataFrame) -> DataFrame:
        once = measures.mentions(arrived).where("ts is not null").select("reaction_id", "problem_id", F.to_date("ts").alias("day")).distinct()
        return once.groupBy("problem_id", "day").agg(F.count("*").alias("mentions"))

    publish({"mentions": version(rows.where("batch < 4"))}, at.removesuffix("/mentions"), {"mentions": ["day"]})
    return publish_changes(version(rows), at, ["day"])


QUERIES: tuple[Query, ...] = (
    ingest_reactions, ingested_volume, ingested_sources, source_from_url, publish_tables, normalize_reactions, dedup_exact, dedup_near, dedup_near_lsh, screen_evidence,
    match_problem_terms, problem_terms, cluster_reactions, assign_problem, mention_volume, mentions_by_day, mention_moving_avg,
    trend_slope, trend_change, source_distribution, source_diversity, evidence_top_k, validation_score, problem_list, problem_detail,
    ideas_for_problem, validated_ideas, idea_problem_match, idea_detail, filter_ideas_by_conditions, combine_problems,
    co_mentioned_problems, personalized_ideas, personalized_grounds, favorite_state, my_page,
    score_when_saved, burst_periods, mentions_in_bursts, stream_problem_volume, frequent_sets, author_sketches, affordable_sets, phrase_candidates, unproven_ideas,
    published_changes,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


#: Tables and measures that oracles share, by name; each may use those before it.
SHARED = {
    "reaction": "SELECT event_id AS reaction_id, ts, user_id AS author_id, event_type AS source, CAST(props->>'$.k' AS INT) AS problem_id, value AS weight FROM events",
    "words": r"SELECT doc_id, source, list_filter(string_split_regex(lower(trim(text)), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents",
    "document": "SELECT d.doc_id, CAST(d.doc_id % 100 AS INT) AS problem_id, source, coalesce(l.quality, 0) AS quality, n_chars FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0",
    "idea": "SELECT p_partkey AS idea_id, p_name AS title, p_type AS category, p_size AS effort, p_retailprice AS cost FROM part",
    "problem_idea": "SELECT CAST(p_partkey % 100 AS INT) AS problem_id, p_partkey AS idea_id FROM part UNION SELECT CAST((p_size * 2) % 100 AS INT), p_partkey FROM part",
    "request": "SELECT c_custkey AS maker_id, c_acctbal AS budget, 5 + c_nationkey AS max_effort, CAST(c_nationkey * 4 + j AS INT) AS problem_id FROM customer, (VALUES (0), (1), (2)) v(j)",
    "volume": "SELECT problem_id, count(*) AS mentions, count(DISTINCT author_id) AS authors FROM reaction GROUP BY 1",
    "change": "SELECT problem_id, CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' THEN 1 ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24' THEN 1 ELSE 0 END) AS BIGINT) AS prior FROM reaction GROUP BY 1",
    "dist": "SELECT problem_id, source, count(*) AS mentions FROM reaction GROUP BY 1, 2",
    "diversity": "SELECT problem_id, round(ln(sum(mentions)) - sum(mentions * ln(mentions)) / sum(mentions), 6) AS source_entropy FROM dist GROUP BY 1",
    "scores": """SELECT v.*, recent, prior, source_entropy, round(100 * (0.4 * ln(1 + mentions) / max(ln(1 + mentions)) OVER () + 0.2 * authors / mentions
        + 0.2 * source_entropy / ln((SELECT count(DISTINCT source) FROM reaction)) + 0.2 * coalesce(0.5 * (1 + (recent - prior) / nullif(recent + prior, 0)), 0.5)), 4) AS validation_score
        FROM volume v JOIN change USING (problem_id) JOIN diversity USING (problem_id)""",
    "series": """SELECT p.problem_id, d.day, coalesce(n.mentions, 0) AS mentions FROM (SELECT DISTINCT problem_id FROM reaction) p
        CROSS JOIN (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM reaction) d
        LEFT JOIN (SELECT problem_id, CAST(ts AS DATE) AS day, count(*) AS mentions FROM reaction GROUP BY 1, 2) n ON n.problem_id = p.problem_id AND n.day = d.day""",
    "evidence": "SELECT * FROM (SELECT problem_id, doc_id, quality, n_chars, row_number() OVER (PARTITION BY problem_id ORDER BY quality DESC, n_chars DESC, doc_id) AS rank FROM document) WHERE rank <= 3",
    "fitting": "SELECT maker_id, problem_id, idea_id, effort, cost FROM request JOIN problem_idea USING (problem_id) JOIN idea USING (idea_id) WHERE cost <= budget AND effort <= max_effort",
    "chosen": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY maker_id ORDER BY covered DESC, best_score DESC, effort, cost, idea_id) AS rank FROM (
        SELECT maker_id, idea_id, count(DISTINCT problem_id) AS covered, max(validation_score) AS best_score, effort, cost FROM fitting JOIN scores USING (problem_id) GROUP BY maker_id, idea_id, effort, cost)) WHERE rank <= 5""",
    "listed": "SELECT * FROM scores WHERE validation_score >= 60 ORDER BY validation_score DESC, problem_id LIMIT 20",
    "ideas_of": "SELECT problem_id, idea_id, title, category, effort, cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY effort, cost, idea_id) AS rank FROM problem_idea JOIN idea USING (idea_id)) WHERE rank <= 10",
    "favorite_log": """SELECT o_custkey AS maker_id, 'idea' AS item_kind, l_partkey AS item_id, o_orderdate AS ts, CASE WHEN l_returnflag = 'R' THEN 'unsave' ELSE 'save' END AS action, l_orderkey AS seq1, CAST(l_linenumber AS BIGINT) AS seq2
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT author_id, 'problem', CAST(problem_id AS BIGINT), ts, 'save', reaction_id, 0 FROM reaction WHERE source = 'signup'""",
    "saved": "SELECT maker_id, item_kind, item_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY maker_id, item_kind, item_id ORDER BY ts DESC, seq1 DESC, seq2 DESC, action DESC) AS n FROM favorite_log) WHERE n = 1 AND action = 'save'",
    "shingled": "SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text) AND len(w) >= 3)",
    "site": """SELECT page_id, url, html, nullif(lower(split_part(list_extract(string_split(split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1), '@'), -1), ':', 1)), '') AS source
        FROM (SELECT *, CASE WHEN starts_with(lower(url), 'http://') THEN substr(url, 8) WHEN starts_with(lower(url), 'https://') THEN substr(url, 9) END AS rest FROM pages)""",
    "lexicon": r"""SELECT min(problem_id) AS problem_id, term FROM (SELECT CAST(item_id % 100 AS INT) AS problem_id, unnest(list_filter(string_split_regex(lower(trim(text)), '[^\pL\pN]+'), lambda x: x <> '')) AS term FROM benchmark)
        GROUP BY term HAVING count(DISTINCT problem_id) = 1""",
    "written": """SELECT row_number() OVER () AS n, source, text FROM (SELECT source, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM site
        UNION ALL SELECT 'conversation', text FROM conversations WHERE role = 'user')""",
    "placed": r"""SELECT source, problem_id, CAST(NULL AS BIGINT) AS author_id FROM (SELECT n, problem_id, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, count(DISTINCT term) DESC, problem_id) AS best
        FROM (SELECT n, unnest(string_split_regex(lower(trim(text)), '[^\pL\pN]+')) AS term FROM written) JOIN lexicon USING (term) GROUP BY n, problem_id) JOIN written USING (n) WHERE best = 1
        UNION ALL SELECT source, problem_id, author_id FROM reaction""",
    "offer": """SELECT maker_id, budget, mask, min({'cost': cost, 'idea': idea_id}) AS o FROM (
        SELECT maker_id, idea_id, cost, CAST(sum(1 << (problem_id % 4)) AS INT) AS mask FROM fitting GROUP BY 1, 2, 3) JOIN (SELECT DISTINCT maker_id, budget FROM request) USING (maker_id) GROUP BY 1, 2, 3""",
    "purchase": """SELECT maker_id, budget, mask AS last, mask AS cover, o.cost AS cost, [o.idea] AS ideas FROM offer UNION ALL
        SELECT p.maker_id, p.budget, f.mask, p.cover | f.mask, p.cost + f.o.cost, list_append(p.ideas, f.o.idea) FROM purchase p JOIN offer f ON f.maker_id = p.maker_id AND f.mask > p.last""",
    "version_after": "SELECT problem_id, CAST(ts AS DATE) AS day, count(*) AS mentions FROM reaction GROUP BY 1, 2",
    "version_before": """SELECT problem_id, CAST(ts AS DATE) AS day, count(*) AS mentions FROM reaction WHERE NOT (reaction_id % 13 = 0 AND ts < TIMESTAMP '2024-01-03')
        AND (CAST(ts AS DATE) - DATE '2024-01-01') // 5 + CASE WHEN reaction_id % 11 = 0 THEN 1 ELSE 0 END < 4 GROUP BY 1, 2""",
    "basket": "SELECT DISTINCT author_id, CAST(ts AS DATE) AS day, problem_id FROM reaction WHERE author_id IS NOT NULL AND ts IS NOT NULL AND problem_id IS NOT NULL",
    "subset": """SELECT author_id, day, problem_id AS last, CAST(problem_id AS VARCHAR) AS problems, CAST(1 AS BIGINT) AS n_items FROM basket UNION ALL
        SELECT s.author_id, s.day, b.problem_id, problems || ',' || b.problem_id, n_items + 1 FROM subset s JOIN basket b ON b.author_id = s.author_id AND b.day = s.day AND b.problem_id > s.last""",
    "costed": """SELECT problem_id, day, mentions, row_number() OVER (PARTITION BY problem_id ORDER BY day) AS n, enter,
        CAST(round(-(mentions * ln(p) + ("all" - mentions) * ln(1 - p)) * 1000000) AS BIGINT) AS calm, CAST(round(-(mentions * ln(q) + ("all" - mentions) * ln(1 - q)) * 1000000) AS BIGINT) AS burst
        FROM series JOIN (SELECT day, sum(mentions) AS "all" FROM series GROUP BY 1) USING (day) JOIN (SELECT problem_id, p, least(2.0 * p, (p + 1) / 2) AS q, enter FROM (
            SELECT problem_id, CAST(sum(mentions) AS DOUBLE) / (SELECT sum(mentions) FROM series) AS p, (SELECT CAST(round(0.5 * ln(count(DISTINCT day)) * 1000000) AS BIGINT) FROM series) AS enter FROM series GROUP BY 1)
            WHERE p > 0 AND p < 1) USING (problem_id)""",
    "walk": """SELECT problem_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS cost0, enter AS cost1, '' AS path0, '' AS path1 FROM costed WHERE n = 1 UNION ALL
        SELECT w.problem_id, c.n, calm + least(cost0, cost1), burst + least(cost0 + enter, cost1), CASE WHEN cost0 <= cost1 THEN path0 ELSE path1 END || '0',
        CASE WHEN cost0 + enter <= cost1 THEN path0 ELSE path1 END || '1' FROM walk w JOIN costed c ON c.problem_id = w.problem_id AND c.n = w.n + 1""",
    "bursts": """SELECT problem_id, min(day) AS burst_start, max(day) AS burst_end, count(*) AS days, CAST(sum(mentions) AS BIGINT) AS mentions, round(CAST(sum(calm - burst) AS DOUBLE) / 1000000, 6) AS weight FROM (
        SELECT c.*, c.n - row_number() OVER (PARTITION BY problem_id ORDER BY c.n) AS run FROM costed c JOIN (SELECT problem_id, CASE WHEN cost0 <= cost1 THEN path0 ELSE path1 END AS path FROM walk WHERE n = (SELECT max(n) FROM costed)) USING (problem_id)
        WHERE substr(path, c.n, 1) = '1') GROUP BY problem_id, run""",
    "vector": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "center": "SELECT label AS problem_id, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vector) GROUP BY 1, 2) GROUP BY 1",
}

ORACLES = {
    "score_when_saved": """SELECT s.*, coalesce(volume, 0) AS volume, reaction_id, source FROM (SELECT maker_id, CAST(item_id AS INT) AS problem_id, ts, seq1, seq2 FROM favorite_log WHERE item_kind = 'problem' AND action = 'save') s
        ASOF LEFT JOIN (SELECT problem_id, ts, max(reaction_id) AS reaction_id, max_by(source, reaction_id) AS source, sum(count(*)) OVER (PARTITION BY problem_id ORDER BY ts)::BIGINT AS volume FROM reaction GROUP BY 1, 2) r
        ON s.problem_id = r.problem_id AND s.ts >= r.ts""",
    "burst_periods": "SELECT * FROM bursts",
    "phrase_candidates": """SELECT first, second, n, llr FROM (SELECT *, round(2 * (n * ln(n * t / (f * s)) + CASE WHEN f > n THEN (f - n) * ln((f - n) * t / (f * (t - s))) ELSE 0 END
        + CASE WHEN s > n THEN (s - n) * ln((s - n) * t / ((t - f) * s)) ELSE 0 END + CASE WHEN t - f - s + n > 0 THEN (t - f - s + n) * ln((t - f - s + n) * t / ((t - f) * (t - s))) ELSE 0 END), 4) AS llr FROM (
        SELECT first, second, n, CAST(sum(n) OVER (PARTITION BY first) AS DOUBLE) AS f, CAST(sum(n) OVER (PARTITION BY second) AS DOUBLE) AS s, CAST(sum(n) OVER () AS DOUBLE) AS t FROM (
        SELECT w[i] AS first, w[i + 1] AS second, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM words) GROUP BY 1, 2)) WHERE n >= 5 AND n * t > f * s) WHERE llr >= 10.83""",
    "unproven_ideas": "SELECT * FROM idea i WHERE NOT EXISTS (SELECT 1 FROM problem_idea p JOIN document e USING (problem_id) WHERE p.idea_id = i.idea_id AND quality = 1)",
    "affordable_sets": """SELECT maker_id, covered, cost, array_to_string(ideas, ',') AS ideas FROM (
        SELECT *, row_number() OVER (PARTITION BY maker_id ORDER BY covered DESC, cost, ideas) AS n FROM (
            SELECT maker_id, CAST(bit_count(cover) AS BIGINT) AS covered, round(cost, 6) AS cost, list_sort(ideas) AS ideas FROM purchase WHERE round(cost, 6) <= budget)) WHERE n = 1""",
    "published_changes": """SELECT *, 'removed' AS change FROM (SELECT * FROM version_before EXCEPT ALL SELECT * FROM version_after)
        UNION ALL SELECT *, 'added' FROM (SELECT * FROM version_after EXCEPT ALL SELECT * FROM version_before)""",
    "frequent_sets": "SELECT problems, n_items, count(*) AS baskets FROM subset WHERE n_items > 1 GROUP BY 1, 2 HAVING count(*) >= 3",
    "stream_problem_volume": "SELECT problem_id, CAST(ts AS DATE) AS day, count(*) AS mentions FROM reaction WHERE NOT (reaction_id % 13 = 0 AND ts < TIMESTAMP '2024-01-03') GROUP BY 1, 2",
    "mentions_in_bursts": """SELECT reaction_id, r.problem_id, ts, source, burst_start, burst_end FROM reaction r JOIN bursts b
        ON r.problem_id = b.problem_id AND ts >= burst_start AND ts < burst_end + INTERVAL 1 DAY""",
    "ingest_reactions": """SELECT reaction_id, ts, author_id, source, problem_id, weight FROM reaction
        UNION ALL SELECT page_id, NULL, NULL, source, NULL, NULL FROM site
        UNION ALL SELECT conv_id, NULL, NULL, 'conversation', NULL, NULL FROM conversations WHERE role = 'user'""",
    "ingested_volume": "SELECT problem_id, count(*) AS mentions, count(DISTINCT author_id) AS authors FROM placed GROUP BY 1",
    "ingested_sources": "SELECT problem_id, source, count(*) AS mentions, round(count(*) / sum(count(*)) OVER (PARTITION BY problem_id), 6) AS share FROM placed GROUP BY 1, 2",
    "source_from_url": "SELECT page_id, url, source FROM site",
    "publish_tables": """SELECT 'problem_list' AS table_name, NULL::BIGINT AS maker_id, problem_id, NULL::BIGINT AS idea_id, NULL::BIGINT AS rank, NULL::VARCHAR AS title, validation_score, NULL::DOUBLE AS best_score FROM listed
        UNION ALL SELECT 'ideas_for_problem', NULL, problem_id, idea_id, rank, title, NULL, NULL FROM ideas_of
        UNION ALL SELECT 'personalized_ideas', maker_id, NULL, idea_id, rank, NULL, NULL, best_score FROM chosen""",
    "normalize_reactions": "SELECT doc_id, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens FROM words WHERE len(w) > 0",
    "dedup_exact": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY coalesce(text, '')",
    "dedup_near": """SELECT a, b, round(n / (sa.s + sb.s - n), 6) AS jaccard FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingled x JOIN shingled y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
        JOIN (SELECT doc_id, count(*) AS s FROM shingled GROUP BY 1) sa ON sa.doc_id = a JOIN (SELECT doc_id, count(*) AS s FROM shingled GROUP BY 1) sb ON sb.doc_id = b WHERE n / (sa.s + sb.s - n) >= 0.7""",
    "screen_evidence": "SELECT doc_id, problem_id, source, quality, n_chars FROM document",
    "match_problem_terms": r"""SELECT doc_id, problem_id, count(*) AS hits, count(DISTINCT term) AS terms FROM (SELECT doc_id, unnest(w) AS term FROM words)
        JOIN lexicon USING (term) GROUP BY 1, 2""",
    "problem_terms": """SELECT source, term, tf, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM (
        SELECT source, term, tf, round(tf * ln((SELECT count(DISTINCT source) FROM documents) / count(*) OVER (PARTITION BY term)), 6) AS score
        FROM (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest(w) AS term FROM words) GROUP BY 1, 2))) WHERE rank <= 10""",
    "assign_problem": """SELECT vec_id, problem_id, cosine FROM (SELECT vec_id, problem_id, cosine, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, problem_id) AS n FROM (
        SELECT vec_id, problem_id, round(list_cosine_similarity(v, c), 6) AS cosine FROM vector, center)) WHERE n = 1""",
    "mention_volume": "SELECT * FROM volume",
    "mentions_by_day": "SELECT * FROM series",
    "mention_moving_avg": "SELECT *, round(avg(mentions) OVER (PARTITION BY problem_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS smooth FROM series",
    "trend_slope": "SELECT problem_id, round(regr_slope(CAST(mentions AS DOUBLE), CAST(day - DATE '1970-01-01' AS DOUBLE)), 6) + 0.0 AS slope FROM series GROUP BY 1",
    "trend_change": "SELECT problem_id, recent, prior, round((recent - prior) / nullif(recent + prior, 0), 6) AS change FROM change",
    "source_distribution": "SELECT problem_id, source, mentions, round(mentions / sum(mentions) OVER (PARTITION BY problem_id), 6) AS share FROM dist",
    "source_diversity": "SELECT * FROM diversity",
    "evidence_top_k": "SELECT * FROM evidence",
    "validation_score": "SELECT * FROM scores",
    "problem_list": "SELECT * FROM listed",
    "problem_detail": """SELECT problem_id, mentions, authors, validation_score, trend, sources, coalesce(evidence, '') AS evidence FROM scores
        JOIN (SELECT problem_id, string_agg(CAST(mentions AS VARCHAR), ',' ORDER BY day) AS trend FROM series GROUP BY 1) USING (problem_id)
        JOIN (SELECT problem_id, string_agg(source || ':' || mentions, ',' ORDER BY source) AS sources FROM dist GROUP BY 1) USING (problem_id)
        LEFT JOIN (SELECT problem_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS evidence FROM evidence GROUP BY 1) USING (problem_id)""",
    "ideas_for_problem": "SELECT * FROM ideas_of",
    "validated_ideas": "SELECT * FROM problem_idea WHERE problem_id IN (SELECT problem_id FROM scores WHERE validation_score >= 60)",
    "idea_problem_match": """SELECT problem_id, idea_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY cosine DESC, idea_id) AS rank FROM (
        SELECT a.vec_id AS problem_id, b.vec_id AS idea_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM vector a, vector b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5""",
    "idea_detail": """SELECT i.idea_id, title, coalesce(problems, '') AS problems, coalesce(evidence, '') AS evidence FROM idea i
        LEFT JOIN (SELECT idea_id, string_agg(CAST(problem_id AS VARCHAR), ',' ORDER BY validation_score DESC, problem_id) AS problems FROM problem_idea JOIN scores USING (problem_id) GROUP BY 1) p ON p.idea_id = i.idea_id
        LEFT JOIN (SELECT idea_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY validation_score DESC, problem_id, rank) AS evidence FROM problem_idea JOIN scores USING (problem_id) JOIN evidence USING (problem_id) GROUP BY 1) e ON e.idea_id = i.idea_id""",
    "filter_ideas_by_conditions": "SELECT * FROM fitting",
    "combine_problems": "SELECT maker_id, idea_id, count(DISTINCT problem_id) AS covered FROM request JOIN problem_idea USING (problem_id) GROUP BY 1, 2 HAVING count(DISTINCT problem_id) >= 2",
    "co_mentioned_problems": "SELECT x.problem_id AS a, y.problem_id AS b, count(DISTINCT x.author_id) AS authors FROM reaction x JOIN reaction y ON x.author_id = y.author_id AND x.problem_id < y.problem_id GROUP BY 1, 2",
    "personalized_ideas": "SELECT maker_id, idea_id, covered, best_score, effort, cost, rank FROM chosen",
    "personalized_grounds": """SELECT maker_id, idea_id, rank, problem_id, validation_score, coalesce(docs, '') AS docs FROM chosen JOIN problem_idea USING (idea_id) JOIN request USING (maker_id, problem_id) JOIN scores USING (problem_id)
        LEFT JOIN (SELECT problem_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS docs FROM evidence GROUP BY 1) USING (problem_id)""",
    "favorite_state": "SELECT * FROM saved",
    "my_page": """SELECT maker_id, item_kind, item_id, ts, NULL AS title, validation_score FROM saved JOIN scores ON problem_id = item_id WHERE item_kind = 'problem'
        UNION ALL SELECT maker_id, item_kind, item_id, ts, title, NULL FROM saved JOIN idea ON idea_id = item_id WHERE item_kind = 'idea'""",
}


def with_shared(sql: str) -> str:
    """``sql`` after the shared tables that it needs."""
    import re

    need: list[str] = []

    def add(text: str, below: list[str]) -> None:
        for name in below:
            if re.search(rf"\b{name}\b", text) and name not in need:
                names = list(SHARED)
                add(SHARED[name], names[: names.index(name)])
                need.append(name)

    add(sql, list(SHARED))
    ordered = [n for n in SHARED if n in need]
    return (f"WITH RECURSIVE {', '.join(f'{n} AS ({SHARED[n]})' for n in ordered)} " if ordered else "") + sql


def oracle_sql() -> dict[str, str]:
    return {name: with_shared(sql) for name, sql in ORACLES.items()}
