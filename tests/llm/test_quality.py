import numpy as np
from pyspark.sql import functions as F

from kindling.llm import quality as q
from kindling.llm.common import labelled_sample
from kindling.llm.queries import op2_quality


def test_votes_by_brute_force():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde "), 80)) if i % 3 else " ".join(["Of"] * 30) + "".join(rng.choice(list("xyz "), 30)) for i in range(90)]
    labels = np.array([int(i % 3 > 0) for i in range(90)])
    df = (q.term_counts(texts) > 0).sum(axis=0)
    model = q.fit(texts, labels, df, len(texts), (1 / 3, 2 / 3))
    fresh = texts[:7] + ["abc abc", "zzz"]
    z = model.latent(fresh)
    got = model.score(fresh, 5)
    for i in range(len(fresh)):
        cosine = [float(z[i] @ v) for v in model.vectors]
        near = sorted(range(90), key=lambda j: -cosine[j])[:5]
        w = [max(cosine[j], 0) ** 8 + 1e-9 for j in near]
        assert abs(got[i] - sum(a * labels[j] for a, j in zip(w, near)) / sum(w)) < 1e-4
    assert ((model.score(texts) >= q.THRESHOLD) == labels).mean() > 0.95


def test_a_long_document_shuts_out_no_other(spark):
    rows = [(i, "few words " * (1 + i % 5)) for i in range(40)] + [(i, "much " * 1000) for i in range(40, 44)]
    docs = spark.createDataFrame(rows + rows[:3] + [(7, "another text of seven")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(44)] + [(None, 1)], "doc_id long, quality int")
    take = lambda chars: labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "quality", 30, chars)
    texts, ys, shares = take(1 << 30)
    assert len(texts) == 44 and ys.sum() == 22 and shares == (0.5, 0.5)
    texts, ys, _ = take(4000)
    assert sum(map(len, texts)) <= 4000 and len(texts) == 40 and ys.sum() == 20 and "much" not in "".join(texts)
    texts, ys, _ = take(10)
    assert ys.tolist().count(0) == 1 and ys.tolist().count(1) == 1
    assert len(labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "quality", 5, 1 << 30)[0]) == 10
    assert labelled_sample(docs, labels.limit(0), F.lit(True), "doc_id", "text", "quality", 5, 100)[0] == []


def test_terms_end_with_their_text():
    apart = q.term_counts(["abc", "def", "", "é"])
    assert (apart == np.concatenate([q.term_counts([t]) for t in ("abc", "def", "", "é")])).all()
    assert apart[0].sum() == 4 and apart[2].sum() == 1
    assert q.repetition(["Of of OF off", "", "one", "a b a b"]).tolist() == [2 / 3, 0.0, 0.0, 0.0]


def test_statistics_cover_all_rows(odd):
    df, n = q.document_frequencies(odd, "text")
    texts = [r.text or "" for r in odd.select("text").collect()]
    assert n == len(texts) and (df == (q.term_counts(texts) > 0).sum(axis=0)).all()


def test_odd_documents(spark, odd, empty, no_labels):
    model = q.fit_quality(odd, no_labels)
    assert [r.quality for r in q.score_quality(odd, model).select("quality").collect()] == [0.0] * odd.count()
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 0), (8, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = q.score_quality(odd, q.fit_quality(odd, labels))
    assert out.count() == odd.count() and out.where("quality between 0 and 1").count() == odd.count()
    assert q.score_quality(empty, q.fit_quality(empty, labels)).count() == 0


def test_held_out_rows_and_query(spark):
    sf = "/root/testdata/sf0.01"
    out = op2_quality(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.where((F.col("score") >= 0.3) != (F.col("predicted") == 1)).count() == 0
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0
    known = out.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    for part in (known[known.held_out], known[~known.held_out]):
        assert (part.predicted == part.quality).mean() > 0.95
        low = part[part.quality == 0]
        assert len(low) and (low.predicted == 0).mean() >= 0.9
