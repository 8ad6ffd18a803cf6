"""Known answers on small frames, and the edge cases of each formula."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kindling.operators import cleaning, discovery, favorites, ideas, measures, personal
from kindling.sources import REACTION as REACTION_COLUMNS
from kindling.sources import Feed, ingest_reactions, publish_tables, read_any, source_from_url

REACTION = "reaction_id bigint, ts timestamp_ntz, author_id bigint, source string, problem_id int, weight double"


def day(n: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def reactions(spark):
    rows = [(1, day(0), 1, "a", 1, 1.0), (2, day(2), 1, "a", 1, 1.0), (3, day(2), 2, "b", 1, 1.0), (4, day(2), 3, "b", 2, 1.0)]
    return spark.createDataFrame(rows, REACTION)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_volume_and_series(reactions):
    assert got(measures.mention_volume(reactions), "problem_id", "mentions", "authors") == [(1, 3, 2), (2, 1, 1)]
    series = measures.mentions_by_day(reactions)
    assert [r[2] for r in got(series, "problem_id", "day", "mentions")] == [1, 0, 2, 0, 0, 1]
    assert got(measures.trend_slope(series), "problem_id", "slope") == [(1, 0.5), (2, 0.5)]
    smooth = {(r.problem_id, r.day.day): r.smooth for r in measures.mention_moving_avg(series, 2).collect()}
    assert smooth[1, 1] == 1.0 and smooth[1, 3] == 1.0 and smooth[2, 3] == 0.5


def test_no_reactions(spark):
    none = spark.createDataFrame([], REACTION)
    for df in (measures.mention_volume(none), measures.mentions_by_day(none), measures.source_distribution(none), measures.trend_change(none, "2024-01-31")):
        assert df.count() == 0


def test_change_without_prior_period(reactions):
    out = {r.problem_id: (r.recent, r.prior, r.change) for r in measures.trend_change(reactions, "2024-01-04", 2).collect()}
    assert out == {1: (2, 1, round(1 / 3, 6)), 2: (1, 0, 1.0)}
    far = measures.trend_change(reactions, "2025-01-01", 2).first()
    assert (far.recent, far.prior, far.change) == (0, 0, None)


def test_shares_and_entropy(reactions):
    dist = measures.source_distribution(reactions)
    assert got(dist, "problem_id", "source", "share") == [(1, "a", 0.666667), (1, "b", 0.333333), (2, "b", 1.0)]
    entropy = {r.problem_id: r.source_entropy for r in measures.source_diversity(dist).collect()}
    assert entropy[2] == 0.0 and entropy[1] == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)), abs=1e-6)


def test_score_and_list(reactions):
    scores = measures.validation_score(measures.problem_measures(reactions, "2024-01-04", 2), 2)
    score = {r.problem_id: r.validation_score for r in scores.collect()}
    assert all(0 <= x <= 100 for x in score.values())
    want = 100 * (0.4 + 0.2 * 2 / 3 + 0.2 * 0.636514 / math.log(2) + 0.2 * 0.5 * (1 + 1 / 3))
    assert score[1] == pytest.approx(want, abs=2e-3)
    assert [r.problem_id for r in measures.problem_list(scores, 0, 1).collect()] == [max(score, key=score.get)]
    one = measures.validation_score(measures.problem_measures(reactions, "2024-01-04", 2), 1)
    assert one.count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 6)), min_size=1, max_size=30))
def test_shares_sum_to_one_and_series_to_volume(spark, events):
    rows = [(i, day(d), i % 4, f"s{s}", p, 1.0) for i, (p, s, d) in enumerate(events)]
    df = spark.createDataFrame(rows, REACTION)
    shares, volume, series = {}, {}, {}
    for r in measures.source_distribution(df).collect():
        shares[r.problem_id] = shares.get(r.problem_id, 0) + r.share
    for r in measures.mention_volume(df).collect():
        volume[r.problem_id] = r.mentions
    for r in measures.mentions_by_day(df).collect():
        series[r.problem_id] = series.get(r.problem_id, 0) + r.mentions
    assert all(abs(x - 1) < 1e-5 for x in shares.values())
    assert series == volume


def test_cleaning(spark):
    docs = spark.createDataFrame([(1, "A b, c d"), (2, "a B c d"), (3, "A b, c d"), (4, "x"), (5, ""), (6, None), (7, "!!")], "doc_id long, text string")
    assert got(cleaning.normalize_reactions(docs), "doc_id") == [(1,), (2,), (3,), (4,)]
    assert got(cleaning.dedup_exact(docs), "doc_id", "copies") == [(1, 2), (2, 1), (4, 1), (5, 2), (7, 1)]
    assert got(cleaning.dedup_near(docs), "a", "b", "jaccard") == [(1, 2, 1.0)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert got(cleaning.screen_evidence(docs, labels), "doc_id", "quality") == [(1, 1), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0)]


def test_near_pairs_by_brute_force(spark):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(40)]
    texts = []
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(40)] = rng.choice(words)
        texts.append(" ".join(t))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(38)} for t in texts]
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    want = {(i, j) for i in first.values() for j in first.values() if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.a, r.b) for r in cleaning.dedup_near(docs).collect()} == want


def test_terms(spark):
    docs = spark.createDataFrame([(1, "x", "Slow app, slow APP"), (2, "y", "slow bus")], "doc_id long, source string, text string")
    lexicon = spark.createDataFrame([(7, "slow"), (7, "app"), (8, "bus")], "problem_id int, term string")
    assert got(discovery.match_problem_terms(docs, lexicon), "doc_id", "problem_id", "hits", "terms") == [(1, 7, 4, 2), (2, 7, 1, 1), (2, 8, 1, 1)]
    top = discovery.problem_terms(docs, 1)
    assert got(top, "source", "term") == [("x", "app"), ("y", "bus")]


def test_nearest_in_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(discovery, "MAX_QUERIES", 1)
    rows = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 2.0]), (13, None)], "idea_id long, embedding array<double>").repartition(3)
    problems = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0])], "problem_id long, embedding array<double>")
    assert got(ideas.idea_problem_match(problems, rows, 1), "problem_id", "idea_id", "cosine") == [(1, 10, 1.0), (2, 12, 1.0)]
    assert ideas.idea_problem_match(problems.limit(0), rows, 1).count() == 0
    centers = problems.select("problem_id", "embedding")
    assert got(discovery.assign_problem(rows.withColumnRenamed("idea_id", "vec_id"), centers), "vec_id", "problem_id") == [(10, 1), (11, 1), (12, 2)]


IDEA = "idea_id long, title string, category string, effort int, cost double"


def test_ideas_and_requests(spark):
    catalogue = spark.createDataFrame([(1, "a", "x", 3, 10.0), (2, "b", "x", 3, 10.0), (3, "c", "x", 9, 1.0)], IDEA)
    links = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (2, 3)], "problem_id int, idea_id long")
    scores = spark.createDataFrame([(1, 80.0), (2, 50.0)], "problem_id int, validation_score double")
    assert got(ideas.ideas_for_problem(links, catalogue, 1), "problem_id", "idea_id") == [(1, 1), (2, 1)]  # equal keys: the lesser id
    assert got(ideas.validated_ideas(links, scores), "problem_id", "idea_id") == [(1, 1), (1, 2)]
    requests = spark.createDataFrame([(7, 20.0, 5, 1), (7, 20.0, 5, 2), (8, -1.0, 5, 1)], "maker_id long, budget double, max_effort int, problem_id int")
    assert got(personal.filter_ideas_by_conditions(requests, links, catalogue), "maker_id", "problem_id", "idea_id") == [(7, 1, 1), (7, 1, 2), (7, 2, 1)]
    assert got(personal.combine_problems(requests, links), "maker_id", "idea_id", "covered") == [(7, 1, 2)]
    best = personal.personalized_ideas(requests, links, catalogue, scores, 5)
    assert got(best, "rank", "maker_id", "idea_id", "covered") == [(1, 7, 1, 2), (2, 7, 2, 1)]
    proof = spark.createDataFrame([(1, 100, 1), (1, 101, 2)], "problem_id int, doc_id long, rank long")
    grounds = {r.idea_id: [(g.problem_id, list(g.docs)) for g in r.grounds] for r in personal.personalized_grounds(best, requests, links, scores, proof).collect()}
    assert grounds == {1: [(1, [100, 101]), (2, [])], 2: [(1, [100, 101])]}
    detail = {r.idea_id: (list(r.evidence), len(r.problems)) for r in ideas.idea_detail(catalogue, links, scores, proof).collect()}
    assert detail == {1: ([100, 101], 2), 2: ([100, 101], 1), 3: ([], 1)}


def test_co_mentions(reactions):
    both = reactions.unionByName(reactions.where("reaction_id = 4").selectExpr("9L as reaction_id", "ts", "1L as author_id", "source", "problem_id", "weight"))
    assert got(personal.co_mentioned_problems(both), "a", "b", "authors") == [(1, 2, 1)]


def test_favourites(spark):
    log = [(1, "idea", 5, day(0), "save", 1, 0), (1, "idea", 5, day(1), "unsave", 2, 0), (1, "idea", 5, day(2), "save", 3, 0), (1, "idea", 6, day(0), "save", 1, 0),
           (1, "idea", 6, day(0), "unsave", 1, 0), (1, "problem", 1, day(4), "save", 9, 0)]
    df = spark.createDataFrame(log, "maker_id long, item_kind string, item_id long, ts timestamp_ntz, action string, seq1 long, seq2 long")
    state = favorites.favorite_state(df)
    assert got(state, "item_kind", "item_id", "ts") == [("idea", 5, day(2)), ("problem", 1, day(4))]
    scores = spark.createDataFrame([(1, 80.0)], "problem_id int, validation_score double")
    catalogue = spark.createDataFrame([(5, "a", "x", 3, 10.0)], IDEA)
    page = favorites.my_page(state, scores, catalogue).collect()
    assert [(r.item_kind, r.title, r.validation_score) for r in page] == [("problem", None, 80.0), ("idea", "a", None)]


def test_sources(spark):
    given = {
        "https://a.b/c": "a.b", "http://x:80?q": "x", "HTTP://Www.Site.ORG#top": "www.site.org", "http://user:pw@host/p@q": "host", "https://u@v@w:1/": "w",
        "http://[::1]:8080/": "[::1]", "nope": None, "ftp://a.b": None, "http://": None, None: None,
    }
    urls = spark.createDataFrame(list(enumerate(given)), "reaction_id long, url string")
    assert {r.url: r.source for r in source_from_url(urls).collect()} == given


def test_ingestion_from_paths(spark, tmp_path):
    urls = spark.createDataFrame([(1, "https://a.b/c"), (2, "nope")], "reaction_id long, url string")
    urls.write.json(f"{tmp_path}/u.json")
    urls.write.orc(f"{tmp_path}/u.orc")
    with open(f"{tmp_path}/v.csv", "w") as f:
        f.write("reaction_id,url\n7,http://q\nnot a number,http://r\n8,http://s\n")
    spark.createDataFrame([(9, "chat", 3)], "reaction_id long, text string, extra int").write.parquet(f"{tmp_path}/chat.parquet")
    schema = "reaction_id long, url string"
    feeds = {
        "json": Feed(f"{tmp_path}/u.json", {"reaction_id": "reaction_id"}, url="url", schema=schema),
        "orc": Feed(f"{tmp_path}/u.orc", {"reaction_id": "reaction_id * 10", "source": "'fixed'"}, where="url <> 'nope'"),
        "csv": Feed(f"{tmp_path}/v.csv", {"reaction_id": "reaction_id"}, url="url", schema=schema),
        "chat": f"{tmp_path}/chat.parquet",
    }
    out = ingest_reactions(spark, feeds)
    assert out.schema == spark.createDataFrame([], REACTION_COLUMNS).schema
    assert got(out, "reaction_id", "source", "text") == sorted([(1, "a.b", None), (2, None, None), (10, "fixed", None), (7, "q", None), (8, "s", None), (9, "chat", "chat")], key=lambda x: (x[0],))
    with pytest.raises(ValueError):
        read_any(spark, f"{tmp_path}/v.csv")
    with pytest.raises(ValueError):
        ingest_reactions(spark, {})
    paths = publish_tables({"t": out}, str(tmp_path), {"t": ["source"]})
    assert spark.read.parquet(paths["t"]).count() == 6


def test_reactions_without_problem_or_time(spark):
    rows = [(1, day(0), 1, "a", 1, 1.0), (2, None, 2, "a", 1, 1.0), (3, day(5), 3, "b", None, 1.0), (4, None, None, None, 2, 1.0)]
    df = spark.createDataFrame(rows, REACTION)
    assert got(measures.mention_volume(df), "problem_id", "mentions", "authors") == [(1, 2, 2), (2, 1, 0)]
    assert [r[2] for r in got(measures.mentions_by_day(df), "problem_id", "day", "mentions")] == [1, 0]  # the day of no problem is not theirs
    both = {r.problem_id: (r.mentions, r.authors, r.recent, r.prior, r.source_entropy) for r in measures.problem_measures(df, "2024-01-04", 7).collect()}
    assert both == {1: (2, 2, 1, 0, 0.0), 2: (1, 0, 0, 0, 0.0)}
    assert got(measures.source_distribution(df), "problem_id", "share") == [(1, 1.0), (2, 1.0)]


def test_measures_in_one_scan_are_the_separate_ones(reactions):
    both = got(measures.problem_measures(reactions, "2024-01-04", 2), "problem_id", "mentions", "authors", "recent", "prior", "source_entropy")
    parts = measures.mention_volume(reactions).join(measures.trend_change(reactions, "2024-01-04", 2), "problem_id")
    parts = parts.join(measures.source_diversity(measures.source_distribution(reactions)), "problem_id")
    assert both == got(parts, "problem_id", "mentions", "authors", "recent", "prior", "source_entropy")


def test_placed_by_text(spark):
    rows = [(1, None, "slow slow app"), (2, None, "BUS!"), (3, 9, "bus"), (4, None, "nothing"), (5, None, None), (6, None, "app bus"), (6, None, "app bus")]
    df = spark.createDataFrame(rows, "reaction_id long, problem_id int, text string")
    lexicon = spark.createDataFrame([(7, "slow"), (7, "app"), (8, "bus")], "problem_id int, term string")
    placed = sorted(((r.reaction_id, r.problem_id) for r in discovery.place_reactions(df, lexicon).collect()), key=lambda x: x[0])
    assert placed == [(1, 7), (2, 8), (3, 9), (4, None), (5, None), (6, 7), (6, 7)]


def test_search_of_many_queries_and_odd_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4)).round(1)
    v[10:20] = v[10]  # ties
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(None, [1.0] * 4), (90, None), (91, []), (92, [1.0, None, 0.0, 0.0]), (93, [float("nan")] * 4), (94, [1.0, 2.0]), (95, [0.0] * 4)]
    df = spark.createDataFrame(rows, "idea_id long, embedding array<double>").repartition(3)
    problems = df.select(discovery.F.col("idea_id").alias("problem_id"), "embedding")
    want = got(ideas.idea_problem_match(problems, df, 3), "problem_id", "rank", "idea_id", "cosine")
    unit = np.array([x for _, x in rows[:60]] + [[0.0] * 4])
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    ids = [*range(60), 95]
    for i, x in zip(ids, unit):
        best = sorted(zip((-np.round(unit @ x, 6)).tolist(), ids))[:3]
        assert [r[2] for r in want if r[0] == i] == [j for _, j in best]
    assert [r[2] for r in want if r[0] == 94] == [94]  # of another length
    monkeypatch.setattr(discovery, "MAX_QUERIES", 8)
    monkeypatch.setattr(discovery, "TILE_ROWS", 16)
    monkeypatch.setattr(discovery, "MAX_CELLS", 40)
    assert got(ideas.idea_problem_match(problems, df, 3), "problem_id", "rank", "idea_id", "cosine") == want
    placed = discovery.assign_problem(df.withColumnRenamed("idea_id", "vec_id"), problems.where("problem_id < 30 or problem_id = 94"))
    nearest = {r.vec_id: r.problem_id for r in placed.collect()}
    assert set(nearest) == {*range(60), 94, 95} and all(nearest[i] == 10 for i in range(10, 20)) and nearest[95] == 0 and nearest[94] == 94


def test_intermediate_tables_go(spark):
    import os

    from kindling import storage

    def tables():
        at = storage.shared_folder(spark).removeprefix("file:")
        return {x for x in os.listdir(at) if x.startswith("kindling-")} if os.path.isdir(at) else set()

    before = tables()
    with storage.scratch(spark):
        a = storage.saved(spark.range(3))
        b = storage.saved(a.where("id > 0"), outlives=True)
        c = storage.saved(spark.range(2))
        assert len(tables() - before) == 3
        storage.release(c, None, spark.range(1))
        assert len(tables() - before) == 2 and a.count() == 3
    assert len(tables() - before) == 1 and b.count() == 2
    storage.release(b)
    storage.saved(spark.range(1))
    storage.clear(spark)
    assert not tables() - before


def test_sketches_of_days_give_authors_of_periods(spark):
    """Within four standard deviations of the exact number on every problem and period, however the days are merged."""

    from pyspark.sql import functions as F

    rows = spark.range(60_000).selectExpr(
        "cast(id % 3 * (id % 2) as int) as problem_id", "cast(pow(id % 977, 2) % (100 + 3000 * (id % 3)) as long) as author_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 40 as int)) as ts"
    ).union(spark.createDataFrame([(1, None, None), (None, 5, None)], "problem_id int, author_id long, ts timestamp_ntz"))
    days = measures.author_sketches(rows)
    assert days.count() == rows.where("problem_id is not null and ts is not null").selectExpr("problem_id", "to_date(ts)").distinct().count()
    for period in (F.trunc("day", "week"), F.lit("all")):
        got = {(r.problem_id, str(r.period)): r.authors for r in measures.authors_of_periods(days, period).collect()}
        exact = rows.where("problem_id is not null and ts is not null").withColumn("day", F.to_date("ts")).groupBy("problem_id", period.alias("period")).agg(F.countDistinct("author_id").alias("n")).collect()
        assert len(got) == len(exact)
        for r in exact:
            assert abs(got[r.problem_id, str(r.period)] - r.n) <= max(1, 4 * 1.04 / math.sqrt(1 << measures.SKETCH_BITS) * r.n)


def test_sketch_query_is_near_the_exact_count(spark):
    import kindling.queries as core
    from kindling.plans import fixtures as fx
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    exact = fx.reactions(spark, d).groupBy("problem_id", F.trunc(F.to_date("ts"), "week").alias("week")).agg(F.countDistinct("author_id").alias("n"))
    got = {(r.problem_id, r.week): r.authors for r in core.queries()["author_sketches"](spark, d).collect()}
    want = {(r.problem_id, r.week): r.n for r in exact.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - n) for k, n in want.items()) <= 1


def test_unproven_ideas_with_null_keys(spark):
    ideas_ = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "idea_id long, title string")
    links = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (None, 3), (10, None), (None, None)], "problem_id int, idea_id long")
    evidence = spark.createDataFrame([(10, 5), (10, 6), (None, 7)], "problem_id int, doc_id long")
    assert sorted(r.title for r in ideas.unproven_ideas(ideas_, links, evidence).collect()) == ["b", "c", "d", "e"]
    assert ideas.unproven_ideas(ideas_, links, evidence.where("false")).count() == 5


def test_phrases_by_the_contingency_table(spark):
    from collections import Counter

    texts = ["new york is new", "New-York, new york!", None, "", "york", "is it new", *["red car"] * 6, *["a b", "b a", "a a"] * 9]
    pairs = Counter()
    for t in texts:
        w = [x for x in "".join(c.lower() if c.isalnum() else " " for c in t or "").split() if x]
        pairs.update(zip(w, w[1:]))
    total = sum(pairs.values())
    want = {}
    for (a, b), n in pairs.items():
        f, s = sum(c for (x, _), c in pairs.items() if x == a), sum(c for (_, y), c in pairs.items() if y == b)
        table = [(n, f, s), (f - n, f, total - s), (s - n, total - f, s), (total - f - s + n, total - f, total - s)]
        llr = 2 * sum(k * math.log(k * total / (r * c)) for k, r, c in table if k)
        if n >= 3 and n * total > f * s and llr >= 1:
            want[a, b] = (n, round(llr, 4))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r["first"], r.second): (r.n, r.llr) for r in discovery.phrase_candidates(df, least=3, ratio=1.0).collect()}
    assert got == want and ("red", "car") in got


@pytest.mark.parametrize("part", [1, 3, 64])
def test_pairs_of_an_author_in_parts(spark, part):
    """A prolific author's pairs, whatever the parts, equal those of all combinations."""
    import random
    from itertools import combinations

    rng = random.Random(part)
    rows = [(a, rng.randrange(40)) for a in range(6) for _ in range(rng.choice([1, 5, 60]))] + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "author_id long, problem_id int")
    want = {}
    for a in range(6):
        for pair in combinations(sorted({p for x, p in rows if x == a and p is not None}), 2):
            want[pair] = want.get(pair, 0) + 1
    assert {(r.a, r.b): r.authors for r in personal.co_mentioned_problems(df, part=part).collect()} == want


def test_reactions_with_a_problem_are_not_placed(spark):
    rows = spark.createDataFrame([(1, 5, "cat dog", 0), (2, None, "cat cat dog", 0), (3, None, None, 0), (4, None, "fish", 0), (5, 6, None, 0)], "reaction_id long, problem_id int, text string, digest int")
    lexicon = spark.createDataFrame([(8, "cat"), (9, "dog")], "problem_id int, term string")
    out = discovery.place_reactions(rows, lexicon)
    assert out.columns == rows.columns
    assert {r.reaction_id: r.problem_id for r in out.collect()} == {1: 5, 2: 8, 3: None, 4: None, 5: 6}


@pytest.mark.parametrize("seed", range(3))
def test_near_pairs_equal_all_pairs(spark, seed):
    import random

    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 40))] for _ in range(8)]
    texts = []
    for words in base * 8:
        words = list(words)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice("abcxyz")
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t, i in first.items()}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x and y}
    got = {(r.a, r.b): r.jaccard for r in cleaning.dedup_near(df).collect()}
    assert got == {k: round(j, 6) for k, j in want.items() if j >= 0.7}
