import random
from itertools import permutations

import pytest

from kindling.llm import interactions as I

WHITE = " \t\n\x0b\x0c\r"


def failed(text):
    """The definition, one character at a time."""
    words, run = [], ""
    for c in text + " ":
        if c in WHITE:
            words += [run] if run else []
            run = ""
        else:
            run += c
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else ""
    return out + ("D" if any(c in "#$%&*|" for c in text) else "")


def test_failures_by_definition(monkeypatch):
    monkeypatch.setattr(I, "PIECE", 7)
    rng = random.Random(1)
    texts = ["", " ", "É" * 100, "a\xa0b c", "A" + "é" * 18, "A" + "é" * 19, "a\x1fb"]
    texts += ["".join(rng.choice(["ab", "Cd", "é", "x", *WHITE, "#", "  "]) for _ in range(rng.randrange(400))) for _ in range(200)]
    texts += [" ".join(rng.choice("abcdefgh") + str(rng.randrange(n)) for _ in range(n)) for n in (49, 50, 51, 100, 200)]
    for text in texts:
        bits = I.text_failures(text.encode())
        assert "".join(c for i, c in enumerate("ABCD") if bits >> i & 1) == failed(text), text


def test_distinct_words_at_the_limit():
    words = [f"w{min(i, 64)}" for i in range(100)]  # 65 of 100
    assert I.text_failures(" ".join(words).encode()) == 0
    assert I.text_failures(" ".join(["w0" if w == "w64" else w for w in words]).encode()) == 2


def by_applying(rows, letters):
    """Every order applied to the rows one by one; Shapley sums over the orders."""
    out, total = {}, {}
    for order in map("".join, permutations(letters)):
        rest = rows
        for step, f in enumerate(order, 1):
            gone, rest = [r for r in rest if f in r[0]], [r for r in rest if f not in r[0]]
            hits = [r for r in rows if f in r[0]]
            out[order, step] = (len(rest), len(gone), len(hits) - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
            total[f] = total.get(f, 0) + len(gone)
    return {k: (*v, total[k[0][k[1] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("letters", ["ABCDE", "xy", "q"])
def test_potentials_give_what_all_orders_give(spark, letters):
    rng = random.Random(len(letters))
    rows = [(rng.choice("pq"), "".join(c for c in letters if rng.random() < 0.4), rng.randrange(2), rng.randrange(2)) for _ in range(300)]
    cells = spark.createDataFrame([(p, sum(1 << letters.index(c) for c in f), 1, g, t) for p, f, g, t in rows], "part string, mask int, n long, good long, toxic long")
    counts = cells.groupBy("part", "mask").sum("n", "good", "toxic").toDF("part", "mask", "n", "good", "toxic")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in I.interactions(counts, letters).collect()}
    want = {(p, *k): v for p in "pq" for k, v in by_applying([r[1:] for r in rows if r[0] == p], letters).items()}
    assert got == want


def test_copies_nulls_and_clashing_names(spark):
    rows = [
        (3, "same", None, 1), (5, "same", "s", 2), (5, "same", "s", 3), (9, "same", "", 4), (None, "same", "s", 5),
        (7, None, "s", 6), (8, "", "s", 7), (2, "alone", "s", 8), (2, "alone", "s", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask int").withColumnRenamed("mask", "digest").repartition(3)
    got = sorted((r.id if r.id is not None else -1, r.part, r.mask) for r in I.document_failures(docs).collect())
    # all are short (1); copies of a lesser id fail E (16), a null id and rows of one id alone do not
    assert got == [(-1, "s", 1), (2, "s", 1), (2, "s", 1), (3, "", 1), (5, "s", 17), (5, "s", 17), (7, "s", 1), (8, "s", 17), (9, "", 17)]
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.part: r for r in I.audit_filters(docs, labels).where("filter_order = 'EABCD' and step = 1").collect()}
    assert set(out) == {"", "s"}
    assert (out["s"].removed, out["s"].kept, out["s"].good_lost, out["s"].toxic_lost, out["s"].unique_fails, out["s"].redundant) == (3, 4, 2, 2, 0, 0)
    assert (out[""].removed, out[""].good_lost, out[""].toxic_lost) == (1, 0, 1)


def test_odd_documents_and_empty_tables(spark, odd, empty, no_labels):
    out = I.audit_filters(odd, no_labels)
    assert out.count() == 600  # one part, the null source
    n = odd.count()
    assert {r.kept + r.removed for r in out.where("step = 1").collect()} == {n}
    assert {(r.good_lost, r.toxic_lost) for r in out.collect()} == {(0, 0)}
    assert I.audit_filters(empty, no_labels).count() == 0


def test_five_megabytes_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(800_000))
    assert I.text_failures(text.encode()) == 0
    assert I.text_failures((text + " w1" * 800_000).encode()) == 2
