"""Secret scans: Boolean trigram queries from each regex, a trigram inverted index per block of
documents, intersected postings, and the regex itself on the candidates only."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as op
from re import _parser as parser

from kindling.llm.common import blocks

#: Alternatives that a query is allowed before it is widened to "any document".
MAX_WORDS = 32


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost, without overlap; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: What the method adds: published token formats and private key headers.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
RULES = BASE_RULES + MORE_RULES


def _words(tree, any_case: bool) -> tuple[set[str] | None, set[frozenset[str]]]:
    """(all strings that the pattern can match, or None if they are many; needs found inside).

    A need is a set of words of which at least one is in every match.
    """
    exact: set[str] | None = {""}
    needs: set[frozenset[str]] = set()

    def cut() -> None:
        nonlocal exact
        if exact and all(len(w) >= 3 for w in exact):
            needs.add(frozenset(exact))
        exact = None

    run: set[str] | None = {""}
    whole = True
    for code, arg in tree:
        if code is op.LITERAL:
            part: set[str] | None = {chr(arg)}
        elif code is op.IN and all(c is op.LITERAL for c, _ in arg):
            part = {chr(c) for _, c in arg}
        elif code is op.SUBPATTERN:
            part, inner = _words(arg[3], any_case)
            needs |= inner
        elif code is op.BRANCH:
            options = [_words(x, any_case) for x in arg[1]]
            if all(w is not None for w, _ in options):
                part = set().union(*(w for w, _ in options))
            else:
                part = None
                firsts = [min(({frozenset(w)} if w and all(len(x) >= 3 for x in w) else n), key=len, default=None) for w, n in options]
                if all(f is not None for f in firsts):
                    needs.add(frozenset().union(*firsts))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, sub = arg
            words, inner = _words(sub, any_case)
            if low:
                needs |= inner
            part = None if words is None else ({""} | words if (low, high) == (0, 1) else words if (low, high) == (1, 1) else None)
        elif code is op.AT:
            part = {""}
        else:
            part = None
        if part is not None and run is not None and len(run) * len(part) <= MAX_WORDS:
            run = {a + b for a, b in itertools.product(run, part)}
            continue
        whole = False
        if run and all(len(w) >= 3 for w in run):
            needs.add(frozenset(run))
        run = part if part is not None and len(part) <= MAX_WORDS else {""}
    if not whole and run and all(len(w) >= 3 for w in run):
        needs.add(frozenset(run))
    return (run if whole else None), needs


@cache
def trigram_query(rule: Rule) -> tuple[tuple[tuple[bytes, ...], ...], ...]:
    """An AND of ORs of ANDs of trigrams that the lower-cased text of every match holds; empty: none is mandatory.

    ``(pas & ass & ssw ..) | (sec & ecr ..)`` for a choice of words, for each run of words that
    the pattern cannot do without. Only ASCII words give trigrams; A-Z is lower-cased.
    """
    words, needs = _words(parser.parse(rule.pattern), rule.any_case)
    if words:
        needs = needs | {frozenset(words)}
    query = []
    for need in sorted(needs, key=sorted):
        lower = sorted({w.lower() for w in need})
        if all(len(w) >= 3 and w.isascii() for w in lower):
            query.append(tuple(tuple(w[i : i + 3].encode() for i in range(len(w) - 2)) for w in lower))
    return tuple(query)


def _codes(data: np.ndarray) -> np.ndarray:
    low = data.astype(np.uint32)
    return low[:-2] << 16 | low[1:-1] << 8 | low[2:]


@cache
def _wanted(rules: tuple[Rule, ...]) -> tuple[np.ndarray, dict[bytes, int]]:
    grams = sorted({g for r in rules for need in trigram_query(r) for word in need for g in word})
    table = np.zeros(1 << 24, dtype=bool)
    number = {g: int.from_bytes(g, "big") for g in grams}
    table[list(number.values())] = True
    return table, number


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def candidates(texts: list[str], rules: tuple[Rule, ...]) -> dict[Rule, list[int] | None]:
    """Rows of ``texts`` whose trigrams satisfy each rule's query; None: the rule has no query.

    One inverted index of the trigrams that the queries name: trigram -> rows that hold it.
    """
    parts = [t.encode("utf-8", "surrogatepass") + b"\0\0" for t in texts]
    data = _LOWER[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    ends = np.cumsum([len(p) for p in parts])
    table, number = _wanted(rules)
    codes = _codes(data)
    at = np.flatnonzero(table[codes])
    entries = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
    gram, row = entries >> 32, entries & 0xFFFFFFFF

    def posting(g: bytes) -> np.ndarray:
        a, b = np.searchsorted(gram, [number[g], number[g] + 1])
        return row[a:b]

    def all_of(sets: Iterator[np.ndarray]) -> np.ndarray:
        out = next(sets)
        for s in sets:
            out = np.intersect1d(out, s, assume_unique=True)
        return out

    found: dict[Rule, list[int] | None] = {}
    for rule in rules:
        query = trigram_query(rule)
        if not query:
            found[rule] = None
            continue
        ors = (np.unique(np.concatenate([all_of(posting(g) for g in word) for word in need])) for need in query)
        found[rule] = all_of(ors).tolist()
    return found


_RUN = re.compile(r"^\[([^\]\\^]+)\]\+$")


@cache
def _class_table(inside: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[b for b in range(128) if re.match(f"[{inside}]", chr(b))]] = True
    return table


def _runs(texts: list[str], rule: Rule) -> Iterator[tuple[int, int, int]]:
    """All matches of a full-scan rule that is one repeated ASCII class: its maximal runs, found on bytes."""
    parts = [t.encode("utf-8", "surrogatepass") + b"\0" for t in texts]
    flat = np.frombuffer(b"\0" + b"".join(parts), dtype=np.uint8)
    inside = _class_table(_RUN.match(rule.pattern)[1])[flat]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= rule.least
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    starts, ends = starts[keep], ends[keep]
    points = np.cumsum((flat & 0xC0) != 0x80)  # code points up to each byte, the first of which is before the texts
    row = np.searchsorted(begin, starts, side="right") - 1
    first = points[starts] - points[begin[row]]
    yield from zip(row.tolist(), first.tolist(), (first + ends - starts).tolist())


def spans_of(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, end, rule number), in code points, end exclusive, sorted by start, then rule."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = candidates(texts, rules)
    for n, rule in enumerate(rules):
        rows = found[rule]
        if rows is None and _RUN.match(rule.pattern) and not rule.any_case:
            for i, s, e in _runs(texts, rule):
                out[i].append((s, e, n))
            continue
        pattern = rule.compiled()
        for i in range(len(texts)) if rows is None else rows:
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((*m.span(), n))
    for spans in out:
        spans.sort(key=lambda x: (x[0], x[2]))
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(``key``, spans array of (kind, start, end)) for each row of ``docs``, over the whole text.

    Null and empty texts have no spans; repeated rows are each scanned; an empty table gives no
    rows; other columns are not read. Documents never move: each task indexes its own blocks, and
    a block's postings are the only state it holds.
    """
    rules = tuple(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                spans = [[{"kind": rules[n].kind, "start": s, "end": e} for s, e, n in x] for x in spans_of(texts, rules)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(spans, kind)], names=["id", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(scan, f"id {kind}, spans {SPANS}").withColumnRenamed("id", key)
