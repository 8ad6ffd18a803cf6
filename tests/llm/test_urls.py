import random

from kindling.llm import urls

SCHEMA = "page_id long, url string, host string, rule string, verdict string"


def brute_force(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_against_brute_force(spark):
    rng = random.Random(6)
    hosts, paths = ["com", "example.com", "www.example.com", "EXAMPLE.com", "a.b.net", "net", "xcom", "", "example.com:80", "é.com", "..com"], ["", "/", "/en", "/en/", "/en/x", "/es/", "/fr/y/z", "/EN/", "/a/b"]
    links = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', ':/'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#top', '?a://b/c'])}" for _ in range(600)]
    links += [None, "", "://", "no url", "x://y://z/en/"]
    df = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(links)], SCHEMA)
    more = [("block", "b.net", "/e"), ("allow", "a.b.net", "/es/"), ("block", "a.b.net", "/es/"), ("block", "com", "")]
    for rules in (urls.RULES, urls.RULES + more, []):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()}
        assert got == {i: brute_force(u, rules) for i, u in enumerate(links)}


def test_odd_pages(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.net/fr/", None, None, None), (1, "http://a.net/fr/", None, None, None), (None, None, None, None, None)], SCHEMA)
    assert sorted(str(r.verdict) for r in urls.judge_urls(df).collect()) == ["allow", "block", "block"]
    assert urls.judge_urls(df.limit(0)).count() == 0
    monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", 0)
    assert urls.judge_urls(df).where("verdict = 'block'").count() == 2


def test_hosts_of_very_many_labels(spark):
    """A megabyte of labels costs what the rules ask for, not its square; suffixes count at dots only."""
    import time

    hosts = [".".join(["a"] * 500_000) + ".example.com", "a" * 1_000_000 + "example.com", "." * 300_000 + "com", "com.", "", "x.com"]
    df = spark.createDataFrame([(i, f"http://{h}/en/x") for i, h in enumerate(hosts)], "page_id long, url string")
    began = time.perf_counter()
    got = [(r.page_id, r.rule, r.verdict) for r in urls.judge_urls(df).select("page_id", "rule", "verdict").orderBy("page_id").collect()]
    assert got == [(0, "example.com/en/", "block"), (1, "com/", "allow"), (2, "com/", "allow"), (3, None, "allow"), (4, None, "allow"), (5, "com/", "allow")]
    assert time.perf_counter() - began < 30
