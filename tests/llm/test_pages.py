import pytest

from kindling.llm import pages as pg
from kindling.llm.queries import op5_html

SITE = """<html><head><title>No</title><style>p{}</style></head><body><header><div class="logo">Site</div></header><div id="cookie-notice"><p>We use cookies here.</p></div>
<nav><ul><li><a href="/">Home</a></li></ul></nav><main><h1>Title &amp; more</h1><p>First   paragraph of the article,<br>with plenty of words to read.<p>Second paragraph with <a href=x>one
link</a>, &quot;quotes&quot; and&nbsp;more.</p><section class="comments"><div class="comment"><p>Great post, thanks!</p></div></section></main>
<aside class="sidebar"><ul><li><a>Related</a></li></ul></aside><form><label>Email</label><input><p>Subscribe</p></form><script>var t="<p>";</script><footer>&copy; us</footer></body></html>"""
TEXT = 'Title & more First paragraph of the article, with plenty of words to read. Second paragraph with one link, "quotes" and more.'


@pytest.fixture(scope="module")
def trees(spark):
    return pg.fit_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_article_without_the_rest(trees):
    assert len(trees.trees.trees) == pg.ROUNDS
    assert pg.main_texts([SITE], trees) == [TEXT]
    assert pg.main_texts([SITE, SITE.replace("<main>", "<div>").replace("</main>", "</div>")], trees) == [TEXT, TEXT]  # without what names it


A, B, C = (
    "The river rose again last night and flooded the lower part of the town, as it has done every spring.",
    "Engineers say that the new dam will hold most of the water back, but it is not ready before next year.",
    "Until then people who live near the bridge are asked to keep their cellars empty and to watch the news.",
)
PARAS = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
BODY = f"{A} {B} {C}"
#: Pages whose names mislead, or that have none: (html, main text).
HARD = {
    "no article or main": (f'<body><div><a href="/">Home</a> <a href="/news">News</a></div><div><h1>Floods again</h1>{PARAS}</div><div>Copyright us</div></body>', f"Floods again {BODY}"),
    "nothing but paragraphs": (f"<html><body><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li><li><a href=c>Shop</a></li></ul><h1>Floods</h1>{PARAS}<div>&copy; 2024 us</div></body></html>", f"Floods {BODY}"),
    "cue-like paragraph": (f'<nav><a href=x>Home</a></nav><article><h1>Floods</h1><p>{A}</p><p class="related-work">{B}</p><p>{C}</p></article><footer>us</footer>', f"Floods {BODY}"),
    "cue-like block": (f'<article><p>{A}</p><div class="share-price-table"><p>{B}</p></div><p>{C}</p></article><footer>us</footer>', BODY),
    "cue-like id": (f'<article><p>{A}</p><section id="comment-on-the-law"><p>{B}</p></section><p>{C}</p></article>', BODY),
    "header in article": (f"<header><a href=/>The Daily</a></header><article><header><h1>Floods again</h1></header>{PARAS}</article><footer>The Daily</footer>", f"Floods again {BODY}"),
    "menu without cues": (f'<div><ul><li><a href="/a">Start</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Money</a></li></ul></div><article><h1>Floods</h1>{PARAS}</article>', f"Floods {BODY}"),
    "comments in article": (f'<article><h1>Floods</h1>{PARAS}<section class="comments"><h3>2 comments</h3><div class="comment"><p>Jo</p><p>My cellar is full of water again, thanks for nothing.</p></div></section></article>', f"Floods {BODY}"),
    "advert in article": (f'<article><p>{A}</p><div class="ad">Buy boots that keep your feet dry today.</div><p>{B}</p><p>{C}</p></article>', BODY),
    "named div": (f'<div class="site-header"><a href=/>Daily</a></div><div class="post-content"><h1>Floods</h1>{PARAS}</div><div class="sidebar"><h3>More</h3><ul><li><a href=x>One</a></li></ul><p>Read our other stories about rain.</p></div><div class="site-footer"><p>All rights reserved by the Daily.</p></div>', f"Floods {BODY}"),
    "cookie notice": (f'<div id="cookie-notice"><p>We use cookies to make this site better for you.</p><button>OK</button></div><main><h1>Floods</h1>{PARAS}</main>', f"Floods {BODY}"),
    "table in article": (f"<nav><a href=/>x</a></nav><article><p>{A}</p><table><tr><td>Year</td><td>Level</td></tr><tr><td>2023</td><td>4 m</td></tr></table><p>{B}</p><p>{C}</p></article>", f"{A} Year Level 2023 4 m {B} {C}"),
    "form": (f"<article><h1>Floods</h1>{PARAS}</article><form><label>Your address</label><input><p>Get our letter every week</p></form>", f"Floods {BODY}"),
}


def test_pages_whose_names_mislead(trees):
    wrong = {k: got for (k, (page, want)), got in zip(HARD.items(), pg.main_texts([p for p, _ in HARD.values()], trees)) if got != want}
    assert not wrong


def test_query_finds_every_article(spark, sf):
    import html
    import re

    bad = 0
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = op5_html(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        x = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        x = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>|</?(?:p|h1)[^>]*>", " ", x))).split())
        bad += x != r.text
        assert r.n_chars == len(r.text)
    assert bad == 0


def test_decoding_is_monotone_and_best():
    import itertools
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(30):
        nodes = [pg.Node("#document", -1, 0, frozenset(), False)]
        for i in range(1, 9):
            nodes.append(pg.Node("div", rng.randrange(i), 1, frozenset(), False, text=rng.choice([0, 5, 40])))
        margin = np.array([rng.uniform(-1, 1) for _ in nodes])
        up = [margin[x.parent] if x.parent >= 0 else 0.0 for x in nodes]
        value = [2 * (m + pg.FOLLOW * min(1, max(0, u))) * np.sqrt(x.text) if x.text else 0 for m, u, x in zip(margin, up, nodes)]
        best = 0.0
        for keep in itertools.product((False, True), repeat=8):
            keep = (True, *keep)
            if all(not keep[i] or keep[nodes[i].parent] for i in range(1, 9)):
                best = max(best, sum(v for v, k in zip(value[1:], keep[1:]) if k))
        kept = pg.decode(nodes, margin)
        assert all(not kept[i] or kept[nodes[i].parent] for i in range(1, 9))
        assert abs(sum(v for v, k in zip(value[1:], kept[1:]) if k) - best) < 1e-9


def test_broken_markup():
    nodes, out = pg.parse("<div><p>a<p>b</div></section><li>c<li>d<table><tr><td>e<td>f<tr><td>g</table>< not a tag <b>x</b>y<!-- open")
    assert [t for _, t in out] == ["a", "b", "c", "d", "e", "f", "g", "< not a tag xy"]
    assert pg.parse("<script>never closed <p>x")[1] == []
    assert pg.parse('<p title="a > b">text</p>')[1][0][1] == "text"
    assert pg.parse("<p title='open>text</p>")[1][0][1] == "text"


def test_training_pages_are_bounded_and_labelled_by_extent(spark):
    article = lambda i: "".join(f"<p>Sentence {i}{j} of the story that only page {i} has, long enough to be read.</p>" for j in range(8))
    page = lambda i: f"<nav><a href=/>Home</a></nav><article><h1>Story {i}</h1>{article(i)}<p>Follow us for more stories.</p></article><footer>us</footer>"
    rows = [(i, None, page(i)) for i in range(12)] + [(100 + i, "same", page(0)) for i in range(40)] + [(200, "same", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sample = pg._sample(pages, "html", "url", 5)
    assert sample.count() == 5 and sample.select("page").distinct().count() == 5
    assert pg._sample(pages, "html", "url", 100).count() == 13  # null addresses and copies bring no more
    nodes, texts = pg.parse(page(3))
    label = pg.taught(nodes)
    told = {t: label[i] for i, t in texts}
    # A text that other pages have too is as much of the article as any.
    assert told["Story 3"] == 1 and told["Follow us for more stories."] == 1 and told["Home"] == 0 and told["us"] == 0


def test_words_of_attributes():
    assert pg.attribute_words(' class="site-header big" id=comment-list') == {"site-header", "site", "header", "big", "comment-list", "comment", "list"}
    assert pg.attribute_words(" class='related-work share-price-table'") == {"related-work", "share-price-table"}


def test_odd_pages(spark, sf):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain text &lt;b", "x"), (3, "u", "plain text &lt;b", "x"), (None, "u", "<nav>menu</nav>", "x"), (4, "u", "<p>" * 3000 + "deep", "x"), (5, "u", "<div>" * 3000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    for trees in (pg.fit_pages(spark.read.parquet(f"{sf}/pages.parquet")), pg.fit_pages(pages)):
        got = [(r.page_id, r.main_text) for r in pg.extract_text(pages, trees).collect()]
        assert got[0] == (1, "") and got[1] == (2, "") and got[2] == got[3] == (3, "plain text <b") and got[4] == (None, "") and got[6] == (5, "")
    assert pg.extract_text(pages.limit(0), pg.fit_pages(pages.limit(0))).count() == 0


def test_a_head_ends_at_what_it_cannot_hold():
    for rest in ("<body><article><h1>A</h1><p>b</p></article>", "<h1>A</h1><p>b</p>", "A<p>b</p>", "<b>A</b><p>b", "</head><p>A</p><p>b</p>"):
        nodes, out = pg.parse(f"<html><head><meta charset=x><title>t</title><script>no</script>\n{rest}")
        assert [t for _, t in out] == ["A", "b"], rest
        assert not any(nodes[i].hidden for i, _ in out)


def test_humps_part_names():
    assert pg.attribute_words(' class="siteNav postBody RelatedWork" id=relatedPosts') == {"sitenav", "site", "nav", "postbody", "post", "body", "relatedwork", "relatedposts", "related", "posts"}


def test_lone_paragraphs_legal_heads_and_humps_in_names(spark, sf):
    model = pg.fit_pages(spark.read.parquet(f"{sf}/pages.parquet"))
    story = [f"This is sentence {i} of a story that somebody wrote for others to read, and it goes on for a while." for i in range(4)]
    ps = "".join(f"<p>{x}</p>" for x in story)
    humps = (
        f'<body><div class="siteNav"><a href=/>Home</a> <a href=/a>About</a></div><div class="postBody"><h1>Title</h1>{ps}</div>'
        '<div class="relatedPosts"><h3>Related</h3><p>Another story that you may like to read.</p></div><div class="siteFooter"><p>Copyright us</p></div></body>'
    )
    pages = {
        "<p>one paragraph</p>": "one paragraph", "<body><p>one paragraph</p></body>": "one paragraph", "<html><body><p>One</p><p>Two of them.</p></body></html>": "One Two of them.",
        "<p>This is a whole sentence that stands alone on its page, and nothing else does.</p>": "This is a whole sentence that stands alone on its page, and nothing else does.",
        f"<html><head><title>t</title><body><article><h1>Title</h1>{ps}</article>": " ".join(["Title", *story]), humps: " ".join(["Title", *story]),
    }
    assert dict(zip(pages, pg.main_texts(list(pages), model))) == pages


def test_long_pages_take_linear_time():
    """Megabytes of what looks like markup and is none: no end of a tag, no closing quote, ends of elements that are not open."""
    import time

    n = 200_000
    pages = ["x<y and " * n, "a <b c" * n, '<p class="' * n, "<!x " * n, "<script>" + "</script " * n, "<!-- " + "a > b " * n, "<div>" * 20_000 + "</span-x>" * n, "<x>" * 20_000 + "<li>a" * 20_000]
    began = time.perf_counter()
    found = [pg.parse(page)[1] for page in pages]
    assert time.perf_counter() - began < 30
    assert found[0][0][1] == ("x<y and " * n).strip() and found[1][0][1].startswith("a <b ca <b c") and found[5] == []


def test_margins_equal_those_of_the_fitted_trees(spark):
    """What tasks compute from arrays is what MLlib predicts for the same rows."""
    import numpy as np
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=(400, 5)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(1)
    model = GBTClassifier(maxIter=6, maxDepth=pg.DEPTH, maxBins=64, stepSize=0.3, seed=7).fit(df)
    want = [r.m for r in model.transform(df).select(vector_to_array("rawPrediction")[1].alias("m")).collect()]
    got = pg.Trees([pg._arrays(t) for t in model.trees], list(model.treeWeights)).margin(x)
    assert np.allclose(got, np.array(want), atol=1e-9)
