import random

import numpy as np

from kindling.llm import decontaminate as dc
from kindling.llm.queries import op7_decontamination

BENCH = "item_id long, text string"


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def brute_force(text, items, similarity):
    """Items by all windows and all items, without index or fingerprints."""
    index = dc.Items(items)
    found = {}
    for i, size in enumerate(index.sizes):
        w, first = dc.word_hashes([text])
        hs = dc.shingle_hashes(w, index.widths[i]).tolist()
        for s in range(len(hs)):
            bag = dc.Counter(hs[s : s + size - index.widths[i] + 1])
            x = dc.weighted_similarity(bag, index.bags[i], index.weight, index.widths[i])
            if x >= similarity:
                found[index.ids[i]] = max(x, found.get(index.ids[i], 0))
    return found


def test_windows_by_brute_force():
    items = [(i, " ".join(words(15 + i % 30, i))) for i in range(40)] + [(90, "two words"), (91, "."), (92, None)]
    rng = random.Random(7)
    texts = []
    for i in range(40):
        w = items[i][1].split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(words(rng.randint(0, 50), 100 + i)) + " " + " ".join(w).upper() + ", " + " ".join(words(rng.randint(0, 50), 200 + i)))
    texts += ["", "nothing of it", "here are TWO, words!"]
    got = dc.matches(texts, dc.Items(items))
    want = [brute_force(t, items, dc.SIMILARITY) for t in texts]
    assert [set(g) for g in got] == [set(w) for w in want]
    assert all(abs(g[k] - w[k]) < 1e-9 for g, w in zip(got, want) for k in g)
    assert sum(map(bool, got)) >= 14 and got[-1] == {90: 1.0}


def test_blocks_miss_nothing_within_the_radius():
    items = dc.Items([(i, " ".join(words(20, i))) for i in range(300)])
    rng = np.random.default_rng(1)
    prints = []
    for _ in range(300):
        fp = int(items.prints[rng.integers(300)])
        for b in rng.choice(64, rng.integers(0, 22), replace=False):
            fp ^= 1 << int(b)
        prints.append(fp)
    prints = np.array(prints, dtype=np.uint64)
    for i in range(300):
        assert items.near(i, prints).tolist() == (np.bitwise_count(prints ^ items.prints[i]) <= dc.RADIUS).tolist()


def test_large_benchmarks_take_passes(spark, monkeypatch):
    items = [(i, " ".join(words(20, i))) for i in range(7)]
    docs = spark.createDataFrame([(i, "x " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items + items[:2], BENCH)
    monkeypatch.setattr(dc, "MAX_ITEMS", 2)
    got = {r.doc_id: [m["item"] for m in r.contamination] for r in dc.find_contamination(docs, bench).collect()}
    assert got == {i: [i] for i in range(7)}


def test_odd_documents(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text of two rows"), (2, None), (3, ""), (None, "with lines with lines")], BENCH)
    out = dc.find_contamination(odd, bench)
    found = sorted((r.doc_id or 0, [m["item"] for m in r.contamination]) for r in out.collect() if r.contamination)
    assert found == [(5, [1]), (5, [1]), (6, [1]), (1 << 60, [None])]
    assert out.count() == 13 and set(out.columns) == set(odd.columns)
    assert dc.find_contamination(empty, bench).count() == 0
    none = dc.find_contamination(odd, bench.limit(0))
    assert none.count() == 13 and none.where("size(contamination) > 0").count() == 0


def test_query_finds_whole_items(spark, sf):
    import re

    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r.item_id, flat(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: flat(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in op7_decontamination(spark, sf).collect()}
    assert set(got) == set(docs)
    for k, t in docs.items():
        assert {i for i, x in items if x in t} <= got[k]


def one_word_changed(text, at):
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


def test_items_under_two_ids_and_on_a_template_are_found_when_edited(spark, monkeypatch):
    text, template = " ".join(words(59, 1)), " ".join(words(60, 2))
    items = [(1, text), (2, text), (3, text.upper() + ".")] + [(10 + i, f"{template} item{i} here") for i in range(6)]
    docs = spark.createDataFrame([(1, one_word_changed(text, 30)), (2, one_word_changed(items[5][1], 25)), (3, "nothing of it")], "doc_id long, text string")
    got = {}
    for most in (20_000, 1, 4):  # the runs do not change what is found
        monkeypatch.setattr(dc, "MAX_ITEMS", most)
        out = dc.find_contamination(docs, spark.createDataFrame(items, BENCH)).collect()
        got[most] = {r.doc_id: [(m["item"], round(m["similarity"], 9)) for m in r.contamination] for r in out}
    assert got[1] == got[20_000] == got[4]
    assert got[1][1] == [(i, round(50 / 60, 9)) for i in (1, 2, 3)] and 12 in dict(got[1][2]) and not got[1][3]


def test_pairs_over_the_limit_are_within_the_radius():
    """One-word edits of short items and spread edits of long ones, all at 0.8 or just above, are found without exception."""
    items = dc.Items([(i, " ".join(words(22 if i % 2 else 59, 1000 + i))) for i in range(1500)])
    missed = 0
    for i, (bag, size) in enumerate(zip(items.bags, items.sizes)):
        hs = np.array(list(bag), dtype=np.uint64)
        changed = hs.copy()
        n = len(hs) // 9  # n of the item's shingles give way to n others: (len - n) / (len + n) >= 0.8
        changed[:n] = dc.mixed(changed[:n] + np.uint64(i + 1))
        fp = dc.simhashes(changed, np.ones(len(hs)), np.array([0]), np.array([len(hs)]))
        missed += not items.near(i, fp)[0]
    assert missed == 0


def test_verdicts_do_not_depend_on_the_runs(spark, monkeypatch):
    """Items on one template, and an edited passage of one of them: the same with one item a run as with all in one."""
    shared = words(15, 1)
    items = [(i, " ".join(shared + words(45, 50 + i))) for i in range(12)] + [(99, " ".join(shared + words(45, 55)))]
    texts = []
    for i in range(12):
        w = items[i][1].split()
        w[40] = "edited"
        texts.append((i, " ".join(words(30, 300 + i) + w + words(9, 400 + i))))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, BENCH)
    got = []
    for most in (1, 2, 1000):
        monkeypatch.setattr(dc, "MAX_ITEMS", most)
        got.append({r.doc_id: [(x["item"], round(x["similarity"], 9)) for x in r.contamination] for r in dc.find_contamination(docs, bench).collect()})
    assert got[0] == got[1] == got[2]
    assert [x[0] for x in got[0][5]] == [5, 99] and all(got[0][i] for i in range(12))


def peak_of(work):
    """(result, seconds, the most MB that were held at once)"""
    import time
    import tracemalloc

    tracemalloc.start()
    try:
        began = time.perf_counter()
        out = work()
        return out, time.perf_counter() - began, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_an_item_at_both_ends_of_a_very_long_text():
    item, filler = " ".join(words(60, 1)), " ".join(words(1000, 2))
    text = " ".join([item, *[filler] * 900, one_word_changed(item, 30)])
    assert len(text) > 5_000_000
    got, seconds, mb = peak_of(lambda: dc.matches([text], dc.Items([(1, item)])))
    assert got == [{1: 1.0}] and seconds < 60 and mb < 700  # hashes of nearly a million words are most of it


def test_very_long_items():
    """Windows of a very long item move on; they are not counted anew, nor do their sums stand side by side."""
    item = " ".join(words(60_000, 5))
    text = " ".join(words(500, 6)) + " " + one_word_changed(item, 30_000) + " " + " ".join(words(500, 7))
    index = dc.Items([(1, item)])
    got, seconds, mb = peak_of(lambda: dc.matches([text], index))
    assert set(got[0]) == {1} and got[0][1] > 0.999 and seconds < 60 and mb < 120


def test_many_ids_of_one_text_are_one_entry():
    text = " ".join(words(40, 1))
    items = dc.Items([(i, text.upper() if i % 2 else text) for i in range(20_000)] + [(None, text), (-1, "else")])
    assert len(items.ids) == 2 and len(items.twins[0]) == 20_001
    assert dc.matches(["x " + text, "none"], items) == [dict.fromkeys([*range(20_000), None], 1.0), {}]


def test_moving_windows_are_the_plain_similarity():
    rng = random.Random(3)
    items = dc.Items([(i, " ".join(rng.choice("abc") for _ in range(12))) for i in range(6)])
    hs = np.array([h for i in (0, 3, 0, 1, 5) for h in items.bags[i].elements()] + [7, 7, 9], dtype=np.uint64)
    for i, bag in enumerate(items.bags):
        moving = dc.Window(hs, bag, items.weight, items.widths[i], items.scales[i])
        for lo in (0, 1, 2, 5, 20, 21, 24):
            want = dc.weighted_similarity(dc.Counter(hs[lo : lo + 8].tolist()), bag, items.weight, items.widths[i])
            assert abs(moving.to(lo, min(lo + 8, len(hs))) - want) < 1e-12
