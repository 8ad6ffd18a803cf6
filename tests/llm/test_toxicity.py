import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from kindling.llm import toxicity as tx
from kindling.llm.queries import op1_toxicity


def test_marginals_by_brute_force():
    rng = np.random.default_rng(0)
    score, first, t = rng.normal(size=11), np.array([0, 4, 4, 5, 11]), rng.normal(size=(2, 2))
    gamma, pair = tx.forward_backward(score, first, t)
    want, together = [], np.zeros(4)
    for a, b in ((0, 4), (4, 5), (5, 11)):
        total, ones, pairs = 0.0, np.zeros(b - a), np.zeros(4)
        for s in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + i] * x for i, x in enumerate(s)) + sum(t[x, y] for x, y in zip(s, s[1:])))
            total += w
            ones += w * np.array(s)
            for x, y in zip(s, s[1:]):
                pairs[2 * x + y] += w
        want.extend(ones / total)
        together += pairs / total
    assert np.allclose(gamma, want)
    assert np.allclose(pair.sum(axis=1), together)


def test_products_are_stable_over_long_chains():
    gamma, _ = tx.forward_backward(np.full(200_000, -3.0), np.array([0, 200_000]), np.array([[1.0, -1.0], [-1.0, 1.0]]))
    assert np.isfinite(gamma).all() and np.allclose(gamma[1000:-1000], gamma[100_000])


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "ba ce di fo gu ly me no".split() for b in "rn st lm tr pp ck".split()]
    bad = ["slimer", "grotz", "blarghian"]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        labels.append(int(i % 5 == 0))
        if labels[-1]:
            for _ in range(rng.randint(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(bad) + rng.choice(["", "", "s"]))
        texts.append(" ".join(t))
    return texts, np.array(labels)


def test_tags_and_offsets():
    texts, labels = corpus()
    model = tx.fit(texts, labels)
    fresh, truth = corpus(200, 2)
    scores, spans = model.score(fresh)
    assert ((scores >= tx.THRESHOLD) == truth).mean() > 0.97
    got, got_spans = model.score(["é🙂 ba GROTZ fo", ""])
    assert [tuple(x) for x in got_spans[0]] == [(6, 11)] and not got_spans[1]
    assert got[0] > 0.5 > got[1]


def test_odd_documents(spark, odd, empty, no_labels):
    model = tx.fit_toxicity(odd, no_labels)
    out = tx.score_toxicity(odd, model)
    assert out.count() == odd.count() and out.where("toxicity.score between 0 and 1").count() == odd.count()
    assert set(odd.columns) == set(out.columns)
    assert tx.score_toxicity(empty, model).count() == 0
    assert tx.fit_toxicity(empty, no_labels).score([""])[0][0] < 0.3
    one = spark.createDataFrame([(4, 1, 1), (5, None, None), (None, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(tx.fit_toxicity(odd, one).cues) == 0  # one class only


def test_held_out_rows_and_query(spark):
    sf = "/root/testdata/sf0.01"
    out = op1_toxicity(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() == docs.count() and out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert out.where((F.col("score") >= 0.3) != (F.col("predicted") == 1)).count() == 0
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0
    known = out.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    for part in (known[known.held_out], known[~known.held_out]):
        assert ((part.predicted == 1) == (part.toxic == 1)).mean() > 0.93
        hits = ((part.predicted == 1) & (part.toxic == 1)).sum()
        assert hits >= 0.9 * (part.toxic == 1).sum() and hits >= 0.9 * (part.predicted == 1).sum()


def test_capital_letters_with_marks_are_the_same_words():
    low, high = (tx.token_features([t])[0] for t in ("réeuxon été ça ÷×", "RÉEUXON ÉTÉ ÇA ÷×"))
    assert (low == high).all()
