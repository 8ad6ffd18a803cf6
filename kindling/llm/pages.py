"""HTML extraction: gradient-boosted trees over DOM-node features, decoded along the tree so that no
node is kept below one that is dropped."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import blocks
from kindling.storage import release, saved

#: Pages that the trees are fitted on at most, drawn by a hash of address and content, and characters of one of them.
TRAIN_PAGES, PAGE_CHARS = 300, 200_000
#: Boosting rounds and depth of a tree; rebuilt forms of each page that they also see (up to four times as many where pages are few).
ROUNDS, DEPTH, FORMS = 20, 5, 4
#: How far a node follows its parent, in log-odds.
FOLLOW = 0.8

# Fixed values of HTML: elements whose text is not shown, whose content is no markup, that a head holds, without content, inline, and closed by a sibling.
HIDDEN = frozenset("script style noscript template textarea title iframe object svg select button head option".split())
RAW = frozenset("script style textarea title noscript iframe".split())
HEAD = frozenset("title base link meta style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
} | {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: A block that these close is looked for no further out than these.
BOUNDS = frozenset("ul ol dl table div section article aside main body html form nav footer header blockquote fieldset".split())
# What web pages by convention call the parts around the main text, the main text, and either.
SIDE_TAGS = frozenset("nav aside form menu dialog".split())
MAIN_TAGS = frozenset(["article", "main"])
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline-share comment comments consent contentinfo cookie cookies copyright "
    "dialog discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination "
    "pager popup privacy promo promoted promotion recommended related replies reply respond responses search share sharing sidebar signup skyscraper social sponsor "
    "sponsored subscribe subscription tags teaser toolbar trending widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody articles body content entry main post story text".split())
PLAIN_WORDS = frozenset(
    "area articles bar block bottom box center column container content global group head inner item items js left line link links list local main page panel posts primary "
    "right row secondary section site slot small stories sub title top unit wrap wrapper zone".split()
)
#: What a convention is worth, in pages, against what the training pages themselves show of a word; words that are kept at most.
PRIOR, MAX_WORDS = 4.0, 4096
TAGS = ("p", "div", "li", "h", "section", "article", "ul", "td", "nav", "header", "footer", "aside", "form", "main", "other")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_STOPS = frozenset(".!?:;\"'”’»)…。！？")

_TAG = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": TAGS.index("h") for i in range(1, 7)} | {"ol": TAGS.index("ul"), "th": TAGS.index("td"), "menu": TAGS.index("nav")}
_WORD_CACHE: dict[str, frozenset[str]] = {}


@dataclass(slots=True)
class Node:
    """A block-level element. Text outside tags and inside inline ones belongs to the nearest."""

    tag: str
    parent: int
    depth: int
    words: frozenset[str]
    hidden: bool
    children: list[int] = field(default_factory=list)
    text: int = 0
    links: int = 0
    inner_tags: int = 0
    closed: bool = False  # its last text ends as a sentence does
    begin: int = 0
    inner: int = 0
    close: int = -1
    end: int = -1
    label: int | None = None


def attribute_words(attributes: str) -> frozenset[str]:
    """The words of class, id and role: each as it is written, and the parts of a compound of which every part is a conventional name
    (``site-header`` or ``siteHeader``, but not ``related-work`` or ``share-price-table``)."""
    found = _WORD_CACHE.get(attributes)
    if found is None:
        written = [w for x in _ATTRIBUTE.findall(attributes) for w in x.strip("\"'").split()]
        words = {w.lower() for w in written}
        for w in written:
            parts = {x for x in _SPLIT.split(_HUMP.sub("-", w).lower()) if x}
            if all(x in SIDE_WORDS or x in MAIN_WORDS or x in PLAIN_WORDS for x in parts):
                words |= parts
        found = frozenset(words)
        if len(_WORD_CACHE) < 10_000:  # what is beyond is worked out each time
            _WORD_CACHE[attributes] = found
    return found


def parse(page: str, told: re.Pattern | None = None) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block nodes, the first standing for the document; text blocks in page order as (node, text)).

    A text block ends wherever a block-level element begins or ends. Character references are decoded,
    white space inside a block is one space, blank blocks are left out. Broken markup is read as
    far as possible: unclosed elements end with their parent, a head at what no head can hold, stray ends are passed over. Time is linear in the page's length for
    elements that close in order; what follows the last ``>`` is text. ``told``: what in an element's attributes
    says its label, for pages that were made for training.
    """
    nodes = [Node("#document", -1, 0, frozenset(), False)]
    out: list[tuple[int, str]] = []
    run: list[str] = []
    stack = [0]
    open_: Counter[str] = Counter()  # open elements by tag, so that none is looked for in vain
    link = 0
    last = page.rfind(">") + 1

    def cut(i: int) -> None:
        """Close the elements of the stack from its ``i``-th on."""
        open_.subtract(nodes[j].tag for j in stack[i:])
        del stack[i:]

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                node = nodes[stack[-1]]
                node.text += len(text)
                node.closed = text[-1] in _STOPS
                if not node.hidden:
                    out.append((stack[-1], text))

    at = 0
    while True:
        m = _TOKEN.search(page, at, last)
        if m is None and (rest := page.find("<!--", max(at, last - 3))) >= 0:  # a comment that is not closed
            piece = page[at:rest]
        else:
            piece = page[at : m.start() if m else len(page)]
        if nodes[stack[-1]].tag == "head" and piece.strip():
            flush()
            cut(len(stack) - 1)
        if piece and not nodes[stack[-1]].hidden:
            run.append(piece)
            if link:
                nodes[stack[-1]].links += len(piece)
        if m is None:
            break
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = last = len(page)
            continue
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if nodes[stack[-1]].tag == "head" and not end and tag not in HEAD:
            flush()
            cut(len(stack) - 1)
        if tag in INLINE:
            nodes[stack[-1]].inner_tags += 1
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                link = max(0, link + (-1 if end else 1))
            continue
        flush()
        if end:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if nodes[stack[i]].tag == tag:
                    nodes[stack[i]].close, nodes[stack[i]].end = m.start(), at
                    cut(i)
                    link = 0
                    break
            continue
        if tag in CLOSES and any(open_[x] for x in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in CLOSES[tag]:
                    cut(i)
                    break
                if nodes[stack[i]].tag in BOUNDS:
                    break
            # A cell or row may close more than one element.
            while len(stack) > 1 and nodes[stack[-1]].tag in CLOSES[tag]:
                cut(len(stack) - 1)
        words = attribute_words(attributes) if attributes else frozenset()
        parent = stack[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, words, nodes[parent].hidden or tag in HIDDEN, begin=m.start(), inner=at))
        if told and (mark := told.search(attributes)):
            nodes[-1].label = int(mark[1])
        nodes[parent].children.append(len(nodes) - 1)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last)
            at = close.end() if close else len(page)
            continue
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(len(nodes) - 1)
            open_[tag] += 1
    flush()
    return nodes, out


def convention(word: str) -> float:
    """Log-odds of the main text that a word has before any page was seen."""
    return math.log((1 + PRIOR * (word in MAIN_WORDS)) / (1 + PRIOR * (word in SIDE_WORDS)))


_COLUMNS = 24


def features(nodes: list[Node], lexicon: dict[str, float], masked: bool = False) -> np.ndarray:
    """One row per node: depth, text and density of its subtree, links, what its attributes and those around it speak for, the kinds of elements
    it is in, how it stands among its siblings, and where in the page. ``masked``: as if no tag or attribute told the parts of the page apart."""
    n = len(nodes)
    text, links, tags, runs, paras = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    before, seen = [0] * n, 0
    for i, node in enumerate(nodes):
        before[i] = seen
        seen += 0 if node.hidden else node.text
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        own = 0 if node.hidden else node.text
        text[i] += own
        links[i] += min(node.links, own)
        tags[i] += 1 + node.inner_tags
        runs[i] += own > 0
        paras[i] += own if node.tag == "p" else 0
        if node.parent >= 0:
            p = node.parent
            text[p] += text[i]
            links[p] += links[i]
            tags[p] += tags[i]
            runs[p] += runs[i]
            paras[p] += paras[i]
    # The deepest node that holds most of the text in paragraphs, or of all text where there are none.
    mass = paras if paras[0] else text
    heart = 0
    while True:
        down = [j for j in nodes[heart].children if mass[j] * 10 > mass[0] * 6]
        if not down or nodes[down[0]].tag == "p":
            break
        heart = down[0]
    rows = np.zeros((n, _COLUMNS + len(TAGS)))
    families = {}
    for i, node in enumerate(nodes):
        if node.children:
            kinds = Counter(nodes[j].tag for j in node.children)
            families[i] = (len(node.children), kinds, sum(text[j] for j in node.children), sum(v for k, v in kinds.items() if len(k) == 2 and k[0] == "h" and k != "hr"))
    low, high = [0.0] * n, [0.0] * n
    inside = [0] * n  # of nav and the like, header, footer
    # 1: in the article element (or the heart) and in nothing that is set apart inside it; -1: in what is set apart; 0: outside.
    in_main, in_heart = [0] * n, [0] * n
    whole = max(text[0], 1)
    for i, node in enumerate(nodes):
        p, tag = node.parent, node.tag
        if masked and (tag in SIDE_TAGS or tag in MAIN_TAGS or tag in ("header", "footer", "section")):
            tag = "div"
        own = 0.0 if masked or not node.words else max(-4.0, min(4.0, sum(lexicon.get(w, 0.0) for w in node.words)))
        low[i], high[i] = (min(own, low[p]), max(own, high[p])) if p >= 0 else (own, own)
        apart = tag in SIDE_TAGS or tag == "footer" or own < -0.5
        opens = tag in MAIN_TAGS
        for state, begins in ((in_main, opens), (in_heart, i == heart)):
            held = state[p] if p >= 0 else 0
            state[i] = (-1 if apart or (opens and tag == "article" and in_main[p]) else held) if held else int(begins)
        inside[i] = (inside[p] if p >= 0 else 0) | (tag in SIDE_TAGS) << 1 | (tag == "header") << 2 | (tag == "footer") << 3
        size, kinds, total, heads = families[p] if p >= 0 else (1, {node.tag: 1}, text[0], 0)
        x = inside[i]
        rows[i, :_COLUMNS] = (
            node.depth, math.log1p(text[i]), math.log1p(node.text), math.log1p(text[i] / tags[i]), links[i] / max(text[i], 1), math.log1p(runs[i]), own, low[i], high[i],
            in_main[i], x >> 1 & 1, x >> 2 & 1, x >> 3 & 1, in_heart[i], math.log1p(size), kinds[node.tag] / size, math.log1p(total / size), text[i] / whole, before[i] / whole,
            (text[p] if p >= 0 else text[0]) / whole, paras[i] / max(paras[0], 1), node.closed, heads, math.log1p(node.text / max(1, node.inner_tags)),
        )
        rows[i, _COLUMNS + _TAG.get(tag, len(TAGS) - 1)] = 1
    return rows


def taught(nodes: list[Node]) -> np.ndarray | None:
    """Labels by the extent of the page's article element (the one of most text; else its main element), not by what the features name: 1 inside, 0
    outside and for what holds it; 0 also for what the markup sets apart inside, and for articles inside the article. None if no
    element says it. That other pages have a text too says nothing: articles share lines."""
    label = np.zeros(len(nodes))
    size = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        size[i] += nodes[i].text
        size[nodes[i].parent] += size[i]
    made = [i for i, x in enumerate(nodes) if x.label == 1]
    for tag in ("article", "main"):
        made = made or [max((i for i, x in enumerate(nodes) if x.tag == tag and not x.hidden), key=lambda i: (size[i], -i), default=-1)]
        made = [i for i in made if i > 0 and size[i]]
    if not made:
        return None
    root = made[0]
    label[root] = 1
    for i in range(root + 1, len(nodes)):
        node = nodes[i]
        apart = node.label == 0 or node.tag in SIDE_TAGS or node.tag in ("footer", "article")
        label[i] = label[node.parent] == 1 and not apart
    return label


_TOLD = re.compile(r'data-told="([01])"')


def rebuilt(page: str, root: Node, draw: random.Random) -> str:
    """The page anew: its article in another element, whose paragraphs may bear any names, among parts that pages have around and inside
    an article. The markup tells the labels; words are the article's own, so that none gives a part away."""
    inner = page[root.inner : root.close if root.close >= 0 else len(page)]
    words = re.sub(r"<[^>]*>", " ", inner).split()[:4000] or ["text"]
    if draw.random() < 0.1:  # a page that is nothing but one or two blocks
        texts = [" ".join(words[at : at + draw.randint(2, 40)]) or "text" for at in draw.sample(range(max(2, len(words))), 2)]
        blocks_ = [f"<{t}>{x}</{t}>" for t, x in zip(draw.choice([["p"], ["p", "p"], ["h1", "p"], ["div"]]), texts)]
        return draw.choice(['<body data-told="1">{}</body>', '<html><body data-told="1">{}</body></html>', '<div data-told="1">{}</div>', '<html data-told="1">{}']).format("".join(blocks_))
    plain = draw.random() < 0.4  # nothing but div and p
    named = 0.0 if plain else draw.choice([0.4, 1.0])

    def some(least: int, most: int) -> str:
        n = draw.randint(least, most)
        at = draw.randrange(max(1, len(words) - n))
        return " ".join(words[at : at + n])

    def name(*cues: str) -> str:
        if draw.random() < named:
            cue = draw.choice(cues)
            return f' {draw.choice(["class", "class", "id"])}="{draw.choice([cue, cue, f"site-{cue}", f"{cue}-box", f"{cue} {some(1, 1).lower()}"])}"'
        return "" if plain or draw.random() < 0.5 else f' class="{re.sub("[^a-z]", "", some(1, 1).lower()) or "x"}"'

    def tag(*tags: str) -> str:
        return "div" if plain or draw.random() < 0.3 else draw.choice(tags)

    def part(tag_: str, names: str, body: str) -> str:
        return f'<{tag_} data-told="0"{names}>{body}</{tag_}>'

    def links(n: int) -> str:
        items = [f'<a href="#">{some(1, 4)}</a>' for _ in range(n)]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if draw.random() < 0.6 else draw.choice([" ", " | ", ""]).join(items)

    def must(*cues: str) -> str:
        """A name, for what is told by its name alone."""
        cue = draw.choice(cues)
        return f' class="{draw.choice([cue, cue, f"site-{cue}", f"{cue}-box", f"{cue}-list"])}"'

    makers = {
        "menu": lambda: part(tag("nav", "ul", "header"), name("menu", "nav", "navigation", "breadcrumb"), links(draw.randint(2, 9))),
        "header": lambda: part(tag("header"), name("header", "masthead", "banner"), f"<a href='#'>{some(1, 3)}</a>" + draw.choice(["", f"<p>{some(2, 6)}</p>", f"<h2>{some(1, 4)}</h2>"])),
        "footer": lambda: part(tag("footer"), name("footer", "copyright"), draw.choice([f"&copy; {some(1, 8)}", f"<p>&copy; {some(2, 9)}</p>", f"<p>{some(3, 12)}</p>{links(3)}", some(1, 6)])),
        "advert": lambda: part("div", must("ad", "advert", "sponsored", "promo"), draw.choice([some(3, 14), f"<p>{some(4, 20)}</p>", f"<a href='#'>{some(2, 8)}</a>"])),
        "notice": lambda: part(draw.choice(["div", "section", "aside"]), must("cookie", "consent", "notice", "newsletter", "subscribe", "popup"), f"<p>{some(5, 25)}</p><button>{some(1, 2)}</button>"),
        "sidebar": lambda: part("aside" if draw.random() < 0.5 else "div", must("sidebar", "related", "widget", "recommended"), f"<h3>{some(1, 4)}</h3>{links(draw.randint(2, 6))}" + draw.choice(["", f"<p>{some(4, 18)}</p>"])),
        "form": lambda: part("form", name("search", "login", "signup"), f"<label>{some(1, 4)}</label><input><p>{some(2, 10)}</p>"),
        "comments": lambda: part(draw.choice(["section", "div", "ol"]), must("comments", "discussion", "replies", "responses"), f"<h3>{some(1, 3)}</h3>" + "".join(
            f'<div class="{draw.choice(["comment", "reply", "item"])}"><p>{some(3, 8)}</p><p>{some(5, 60)}</p></div>' for _ in range(draw.randint(1, 5)))),
        "share": lambda: part("div", must("share", "social", "tags"), links(draw.randint(2, 5))),
    }

    def parts(kinds: str, most: int) -> str:
        return "".join(makers[draw.choice(kinds.split())]() for _ in range(draw.randint(0, most)))

    def paragraph(m: re.Match) -> str:
        if draw.random() < 0.25:
            cue, other = draw.choice(sorted(SIDE_WORDS)), re.sub("[^a-z]", "", some(1, 1).lower()) or "x"
            return f'<{m[1]} class="{draw.choice([f"{cue}-{other}", f"{other}-{cue}", other, f"{other}-{cue}-{m[1]}"])}">'
        return m[0]

    inner = re.sub(r"<(p|h[1-6]|ul|section)>", paragraph, inner)
    if draw.random() < 0.4:  # a header of the article's own
        inner = re.sub(r"<h1[^>]*>.*?</h1>", lambda m: f"<header>{m[0]}{draw.choice(['', f'<p>{some(2, 6)}</p>'])}</header>", inner, count=1, flags=re.S)
    ends = [m.end() for m in re.finditer(r"</p>", inner)]
    if len(ends) > 2 and draw.random() < 0.5:
        at = draw.choice(ends[:-1])
        inner = inner[:at] + makers[draw.choice(["advert", "notice", "sidebar", "share"])]() + inner[at:]
    if len(ends) > 1 and draw.random() < 0.3:
        inner = inner[: ends[0]] + draw.choice([f"<table><tr><td>{some(1, 3)}</td><td>{some(1, 3)}</td></tr></table>", f"<ul><li>{some(3, 15)}</li><li>{some(3, 15)}</li></ul>", f"<blockquote>{some(5, 30)}</blockquote>", f"<figure><figcaption>{some(3, 12)}</figcaption></figure>"]) + inner[ends[0] :]
    if draw.random() < 0.3:
        inner = f"<div{'' if plain else name('content', 'entry')}>{inner}</div>"
    inner += parts("share comments sidebar", 2)
    wrap, bare = tag("article", "main", "section", "article"), draw.random() < 0.25  # bare: nothing holds the article but the page
    body = inner if bare else f'<{wrap} data-told="1"{"" if draw.random() < 0.5 else name("content", "article", "post", "story")}>{inner}</{wrap}>'
    page = parts("menu header advert notice form", 4) + body + parts("comments sidebar advert footer form", 3) + (makers["footer"]() if draw.random() < 0.7 else "")
    if draw.random() < 0.3 and not bare:
        page = f"<div>{page}</div>"
    return f"<html><head><title>{some(2, 6)}</title></head><body{' data-told="1"' if bare else ''}>{page}</body></html>"


def examples(page: str, forms: int = FORMS) -> Iterator[tuple[list[Node], np.ndarray, bool]]:
    """(nodes, labels, whether names are masked) of a page that names its article: as it is, without names, and rebuilt ``forms`` times."""
    nodes, _ = parse(page)
    label = taught(nodes)
    if label is None:
        return
    yield nodes, label, False
    yield nodes, label, True
    root = nodes[int(np.flatnonzero(label == 1)[0])]
    draw = random.Random(xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")))
    for _ in range(forms):
        nodes, _ = parse(rebuilt(page, root, draw), _TOLD)
        yield nodes, taught(nodes), False


@dataclass
class Trees:
    """Boosted regression trees as arrays: per tree feature (-1: leaf), threshold, left, right, value."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Half log-odds of label 1."""
        out = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            out += weight * value[at]
        return out


def _arrays(tree) -> tuple[np.ndarray, ...]:
    rows: list[list] = []

    def walk(node) -> int:
        i = len(rows)
        rows.append([-1, 0.0, i, i, node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            rows[i][:2] = [split.featureIndex(), split.threshold()]
            rows[i][2] = walk(node.leftChild())
            rows[i][3] = walk(node.rightChild())
        return i

    walk(tree._java_obj.rootNode())
    return tuple(np.array(c) for c in zip(*rows))


@dataclass
class Model:
    """The trees, and what the words of attributes speak for."""

    trees: Trees
    lexicon: dict[str, float]


def _sample(pages: DataFrame, html: str, key: str, train_pages: int) -> DataFrame:
    """(h, page) of at most ``train_pages`` different pages whose markup names its article, a written table."""
    body = F.col(html).cast("string")
    drawn = pages.select(F.xxhash64(F.col(key).cast("string"), body).alias("h"), body.alias("page"))
    drawn = drawn.where((F.length("page") <= PAGE_CHARS) & F.lower("page").rlike("<(article|main)[ >]"))
    ids = drawn.select("h").distinct().orderBy("h").limit(train_pages)
    return saved(drawn.join(F.broadcast(ids), "h").dropDuplicates(["h"]))


def fit_pages(pages: DataFrame, html: str = "html", key: str = "url", train_pages: int = TRAIN_PAGES) -> Model:
    """Fitted on the nodes of at most ``train_pages`` different pages of at most PAGE_CHARS characters whose markup names its article, drawn by a hash of
    ``key`` and content (repeated rows and null addresses bring no more). Labels come from the extent of the article element; the
    trees also see each page without its names, and rebuilt with other parts and names. No such page: no trees, and pages are read
    by the conventional names alone."""
    sample = _sample(pages, html, key, train_pages)
    forms = min(4 * FORMS, max(FORMS, FORMS * train_pages // max(1, sample.count())))
    sc = pages.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(0):
                first = next(examples(page.as_py()), None)
                if first is not None:
                    nodes, label, _ = first
                    rows += {(w, int(y)) for node, y in zip(nodes, label) if not node.hidden for w in node.words}
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], names=["word", "y"])

    words = sample.select("page").mapInArrow(count, "word string, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    top = words.orderBy(F.desc(F.col("a") + F.col("b")), "word").limit(MAX_WORDS).collect()
    lexicon = {w: convention(w) for w in SIDE_WORDS | MAIN_WORDS}
    lexicon |= {r["word"]: convention(r["word"]) + math.log((1 + r["a"]) / (1 + r["b"])) for r in top}
    known = sc.broadcast(lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                for nodes, label, masked in examples(page.as_py(), forms):
                    use = np.array([not x.hidden for x in nodes])
                    x = features(nodes, known.value, masked)[use]
                    flat = pa.array(x.ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, x.shape[1], dtype=np.int32)), flat)
                    yield pa.RecordBatch.from_arrays([lists, pa.array(label[use])], names=["x", "label"])

    table = saved(sample.repartition(8, "h").sortWithinPartitions("h").select("page").mapInArrow(rows, "x array<double>, label double"))
    try:
        if table.select("label").distinct().count() < 2:
            return Model(Trees([], []), lexicon)
        model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, maxBins=64, stepSize=0.3, seed=7, cacheNodeIds=False).fit(table.select(array_to_vector("x").alias("features"), "label"))
    finally:
        release(table, sample)
    return Model(Trees([_arrays(t) for t in model.trees], list(model.treeWeights)), lexicon)


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The set of kept nodes of greatest total worth that holds the parent of each of its nodes.

    A node is worth its log-odds, weighted by its own text, and as much again as its parent speaks for the main text (FOLLOW): what stands
    in an article without a mark of its own follows it. Bottom up, a subtree is worth its node and those child subtrees that are worth something; top
    down, it is kept if it is worth something and its parent is kept. What has no text of its own only passes its children on.
    """
    n = len(nodes)
    above = FOLLOW * np.clip(margin, 0.0, 1.0)
    worth = [2 * (m + (above[x.parent] if x.parent >= 0 else 0.0)) * math.sqrt(x.text) if x.text else 0.0 for m, x in zip(margin.tolist(), nodes)]
    for i in range(n - 1, 0, -1):
        if nodes[i].hidden:
            worth[i] = -math.inf
        elif worth[i] > 0 and nodes[i].parent >= 0:
            worth[nodes[i].parent] += worth[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and worth[i] > 0
    return kept


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of each page; the trees see the nodes of all of them at once."""
    parsed = [parse(page) for page in pages]
    if not parsed:
        return []
    x = np.concatenate([features(nodes, model.lexicon) for nodes, _ in parsed])
    margins = model.trees.margin(x) if model.trees.trees else np.where((x[:, 7] < 0) | (x[:, 10:13].max(axis=1) > 0), -1.0, 1.0)
    texts, at = [], 0
    for nodes, out in parsed:
        margin = margins[at : at + len(nodes)]
        at += len(nodes)
        kept = decode(nodes, margin)
        alone = len(nodes) == 1  # plain text
        texts.append(" ".join(text for i, text in out if kept[i] and (i or alone or margin[0] > 0)))
    return texts


def _extractor(sent: Broadcast):
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([text for _, pages in blocks(array) for text in main_texts(pages, sent.value)], pa.string())

    return run


def extract_text(pages: DataFrame, model: Model, html: str = "html", column: str = "main_text") -> DataFrame:
    """``pages`` with ``column``: the main text of the whole page, blocks joined by a space, empty if there is none.

    Null, empty and text-free pages give the empty text. Plain text without markup is one block of the document.
    Repeated rows come out alike; an empty table gives no rows; a column named as ``column`` is replaced. Pages do not
    move between tasks; tasks are sent ROUNDS trees of at most 2^DEPTH leaves.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    return pages.withColumn(column, F.arrow_udf(_extractor(sent), "string").asNondeterministic()(F.col(html).cast("string")))
