"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, and exact
weighted-shingle similarity on the candidates."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import HashTable, blocks, mixed, small, span_hashes, word_spans
from kindling.storage import release, saved

#: Words of a shingle; windows at this weighted similarity to an item contaminate a document.
WORDS, SIMILARITY = 5, 0.8
#: Fingerprints within so many bits are candidates. Eight blocks of a byte, probed within two bits: a pair
#: that differs by three bits or more in every block is at least 24 bits apart.
RADIUS = 23
#: Items (and characters of items) that tasks are sent at once; a larger benchmark takes several passes.
MAX_ITEMS, MAX_CHARS = 20_000, 20_000_000
#: Windows that are fingerprinted at once, and words whose bits are summed at once.
BATCH = 4096

_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, first word of each text and the total). Words are runs of
    ASCII letters and digits and of any other letters and signs beyond ASCII, in lower case."""
    data, starts, ends, first, _ = word_spans([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    return span_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each word on; too near the end: fewer rows."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    turned = np.empty(n, dtype=np.uint64)
    for j in range(width):
        np.multiply(words[j : j + n], _MULTIPLIERS[j], out=turned)
        h += turned
    return mixed(h)


class Items:
    """Benchmark items, indexed: shingles by hash, fingerprints by Hamming blocks.

    ``counts``: how many texts of the whole benchmark hold a shingle, by (width, hash), where it is more
    than one; None: counted over ``rows``. Texts of the same words are one, under several ids (``twins``). Of an item only its rarest shingles are
    indexed: what is passed over weighs less than ``similarity`` of the item, so that a match holds one of those that are.
    """

    def __init__(self, rows: list[tuple[int, str]], width: int = WORDS, counts: dict[tuple[int, int], int] | None = None, similarity: float = SIMILARITY):
        words, first = word_hashes([t or "" for _, t in rows])
        self.ids, self.twins, self.widths, self.bags = [], [], [], []
        self.sizes: list[int] = []
        shingles: set[tuple[int, int]] = set()
        seen: dict[int, int] = {}
        local: Counter = Counter()
        for (item, _), a, b in zip(rows, first, first[1:]):
            if a == b:
                continue  # an item of no words is in no document
            same = words_key(words[a:b])
            if same in seen:
                self.twins[seen[same]].append(item)
                continue
            seen[same] = len(self.ids)
            w = min(width, b - a)
            bag = Counter(shingle_hashes(words[a:b], w).tolist())
            shingles.update((w, h) for h in bag)
            if counts is None:
                local.update((w, h) for h in bag)
            self.ids.append(item)
            self.twins.append([item])
            self.widths.append(int(w))
            self.bags.append(bag)
            self.sizes.append(int(b - a))
        # A shingle weighs less the more texts share it.
        counts = local if counts is None else counts
        self.weight = {x: 1.0 / counts.get(x, 1) for x in shingles}
        self.scales = [scale_of(bag, self.weight, w) for bag, w in zip(self.bags, self.widths)]
        # Fingerprints are taken with weights of at most the power of two below the item's scale.
        levels = [2.0 ** np.floor(np.log2(x * (1 + 1e-12))) for x in self.scales]
        self.kinds = sorted(set(zip(self.sizes, levels)))
        number = {kind: k for k, kind in enumerate(self.kinds)}
        self.kind_of = [number[kind] for kind in zip(self.sizes, levels)]
        holders: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(len(self.ids)):
            for h in self._rare(i, similarity):
                holders[self.widths[i], h].append(i)
        self.known = {}
        for w in sorted(set(self.widths)):
            hs = np.array(sorted(h for x, h in shingles if x == w), dtype=np.uint64)
            items = [np.array(holders.get((w, int(h)), ()), dtype=np.int64) for h in hs]
            self.known[w] = (HashTable(hs), np.array([self.weight[w, int(h)] for h in hs]), items)
        self.prints = np.array([self._print_of(i, levels[i]) for i in range(len(self.ids))], dtype=np.uint64)
        #: Per block and byte a bitmap of the items whose own byte is within two bits of it.
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :, None] ^ self.prints[:, None].view(np.uint8).T[:, None, :]) <= 2
        self.blocks = np.packbits(near, axis=2)

    def _rare(self, i: int, similarity: float) -> list[int]:
        """The item's shingles but the most common ones, as long as those weigh less than ``similarity`` of all."""
        bag, w = self.bags[i], self.widths[i]
        order = sorted(bag, key=lambda h: (self.weight[w, h], h))
        whole, held = self.scales[i] * sum(bag.values()), 0.0
        for at, h in enumerate(order):
            held += self.weight[w, h] * bag[h]
            if held >= similarity * whole * (1 - 1e-9):
                return order[at:]
        return order

    def _print_of(self, i: int, level: float) -> int:
        hs = np.array(list(self.bags[i].elements()), dtype=np.uint64)
        weights = np.minimum([self.weight[self.widths[i], int(h)] for h in hs], level)
        return int(simhashes(hs, weights, np.array([0]), np.array([len(hs)]))[0])

    def near(self, i: int, prints: np.ndarray) -> np.ndarray:
        """Which of ``prints`` are within RADIUS of item ``i``: those that a block's bitmap has it under, then by distance."""
        byte = prints[:, None].view(np.uint8)
        listed = (self.blocks[np.arange(8), byte, i >> 3] >> np.uint8(7 - (i & 7)) & 1).any(axis=1)
        return listed & (np.bitwise_count(prints ^ self.prints[i]) <= RADIUS)


class Sums:
    """Weighted sums of the signed bits of all of ``hs`` before a place, for places that do not fall from call to call: in
    whole numbers, by BATCH hashes, so that memory does not grow with what lies between places."""

    def __init__(self, hs: np.ndarray, weights: np.ndarray):
        self.hs, self.weights, self.at, self.total = hs, weights, 0, np.zeros(64)

    def before(self, places: np.ndarray) -> np.ndarray:
        out = np.tile(self.total, (len(places), 1))
        while self.at < places[-1]:
            to = min(self.at + BATCH, int(places[-1]))
            bits = np.unpackbits(self.hs[self.at : to, None].view(np.uint8), axis=1)
            sums = np.cumsum((bits * 2.0 - 1.0) * np.rint(self.weights[self.at : to] * 720720)[:, None], axis=0) + self.total
            here = slice(*np.searchsorted(places, [self.at, to], side="right"))
            out[here] = sums[places[here] - self.at - 1]
            self.at, self.total = to, sums[-1]
        return out


def simhashes(hs: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Weighted 64-bit SimHash of each run ``hs[start:end]``; neither starts nor ends fall."""
    return _prints(Sums(hs, weights), Sums(hs, weights), starts, ends)


def _prints(head: Sums, tail: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.packbits(tail.before(ends) > head.before(starts), axis=1).view(np.uint64).ravel()


def words_key(words: np.ndarray) -> int:
    """A 64-bit hash of a text's words in their order."""
    return xxhash.xxh3_64_intdigest(words.tobytes())


def scale_of(bag: Counter, weight: dict, width: int) -> float:
    """What a shingle of an item weighs on average."""
    return sum(weight[width, h] * n for h, n in bag.items()) / sum(bag.values())


def weighted_similarity(a: Counter, b: Counter, weight: dict, width: int, scale: float | None = None) -> float:
    """Weighted Jaccard of two bags of shingles, ``b`` an item's; what is not of the item weighs as
    its own shingles do on average (``scale``), so that it does not matter how many items share them all."""
    scale = scale_of(b, weight, width) if scale is None else scale
    both = union = 0.0
    for h in a.keys() | b.keys():
        w = weight[width, h] if h in b else scale
        both += w * min(a[h], b[h])
        union += w * max(a[h], b[h])
    return both / union if union else 0.0


class Window:
    """The :func:`weighted_similarity` of a window of ``hs`` to an item as the window moves on: by what enters and leaves it."""

    def __init__(self, hs: np.ndarray, bag: Counter, weight: dict, width: int, scale: float):
        self.hs, self.bag, self.weight, self.width, self.scale = hs, bag, weight, width, scale
        self.whole = sum(weight[width, h] * n for h, n in bag.items())
        self.lo = self.hi = 0
        self.held, self.both, self.all = Counter(), 0.0, 0.0

    def to(self, lo: int, hi: int) -> float:
        """Neither end falls from call to call."""
        if lo >= self.hi:
            self.lo = self.hi = lo
            self.held, self.both, self.all = Counter(), 0.0, 0.0
        for a, b, step in ((self.hi, hi, 1), (self.lo, lo, -1)):
            for h in self.hs[a:b].tolist():
                mine = self.bag.get(h, 0)
                w = self.weight[self.width, h] if mine else self.scale
                more = self.held[h] + (step < 0 and -1)  # without the one that enters or leaves
                self.all += step * w
                if more < mine:
                    self.both += step * w
                if more + (step > 0):
                    self.held[h] = more + (step > 0)
                else:
                    del self.held[h]
        self.lo, self.hi = lo, hi
        return self.both / (self.all + self.whole - self.both)


def matches(texts: list[str], items: Items, similarity: float = SIMILARITY) -> list[dict[int, float]]:
    """For each text the items that a window of it matches, with the best similarity.

    Windows of the size of an item (and for its level of weights), cut at the end of the text, begin at every word from which they
    hold an indexed shingle of an item of that size; windows without one are less similar than the limit.
    """
    out: list[dict[int, float]] = [{} for _ in texts]
    words, first = word_hashes(texts)
    for width, (known, weights, items_of) in items.known.items():
        hs = shingle_hashes(words, width)
        hits, grams = known.find(hs)
        owner = np.searchsorted(first, hits, side="right") - 1
        fits = hits + width <= first[owner + 1]
        hits, grams, owner = hits[fits], grams[fits], owner[fits]
        for d in np.unique(owner):
            mine = owner == d
            lo, hi = int(first[d]), int(first[d + 1]) - width + 1
            at: dict[int, list[int]] = defaultdict(list)
            for p, g in zip((hits[mine] - lo).tolist(), grams[mine].tolist()):
                for i in items_of[g].tolist():
                    at[i].append(p)
            h = hs[lo:hi]
            known_as = np.ones(len(h))
            known_as[hits[mine] - lo] = weights[grams[mine]]
            of_kind: dict[int, list[int]] = defaultdict(list)
            for i in at:
                of_kind[items.kind_of[i]].append(i)
            for kind, those in of_kind.items():
                size, level = items.kinds[kind]
                w, reach = np.minimum(known_as, level), size - width
                places = {i: np.array(sorted(set(at[i]))) for i in those}
                marks = np.zeros(len(h) + 1, dtype=np.int64)
                p = np.unique(np.concatenate(list(places.values())))
                np.add.at(marks, np.maximum(p - reach, 0), 1)
                np.add.at(marks, p + 1, -1)
                starts = np.flatnonzero(np.cumsum(marks[:-1]))
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > max(reach, BATCH)) + 1) if len(starts) else ():
                    base, best, moving = int(run[0]), {}, {}
                    head, tail = Sums(h[base:], w[base:]), Sums(h[base:], w[base:])
                    for block in range(0, len(run), BATCH):
                        s = run[block : block + BATCH]
                        e = np.minimum(s + reach + 1, len(h))
                        prints = _prints(head, tail, s - base, e - base)
                        for i in those:
                            holds = np.flatnonzero(np.searchsorted(places[i], e) > np.searchsorted(places[i], s))
                            for x in holds[items.near(i, prints[holds])].tolist():
                                if i not in moving:
                                    moving[i] = Window(h, items.bags[i], items.weight, width, items.scales[i])
                                best[i] = max(best.get(i, (0.0,)), (moving[i].to(int(s[x]), int(e[x])), int(s[x]), int(e[x])))
                    for i, (_, a, b) in best.items():  # sums that moved are rounded otherwise
                        like = weighted_similarity(Counter(h[a:b].tolist()), items.bags[i], items.weight, width, items.scales[i])
                        if like >= similarity:
                            for one in items.twins[i]:
                                out[d][one] = max(like, out[d].get(one, 0.0))
    return out


#: An item as tasks get it: id, text, and its shared shingles with the number of texts that hold them.
Row = tuple[int, str, np.ndarray, np.ndarray]


def _keyed(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(id, body, key, width, hs) of the distinct items: a hash of the words, the distinct shingles and their width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, widths, shingles = [], [], []
            for body in batch.column(1):
                words, _ = word_hashes([body.as_py() or ""])
                w = min(WORDS, len(words))
                keys.append(words_key(words))
                widths.append(w)
                shingles.append(np.unique(shingle_hashes(words, w)).view(np.int64) if w else np.zeros(0, dtype=np.int64))
            key = pa.array(np.array(keys, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), key, pa.array(widths, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))],
                names=["id", "body", "key", "width", "hs"],
            )

    rows = benchmark.select(F.col(item).cast("long").alias("id"), F.col(text).cast("string").alias("body")).distinct()
    return rows.mapInArrow(run, "id long, body string, key long, width int, hs array<long>")


def _with_counts(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(id, body, shared) of the distinct items: ``shared`` holds (h, n) of each shingle that ``n`` > 1 texts of the benchmark have."""
    keyed = saved(_keyed(benchmark, item, text))
    shingles = keyed.dropDuplicates(["key"]).select("key", "width", F.explode("hs").alias("h"))
    counts = saved(shingles.groupBy("width", "h").agg(F.count("*").alias("n")).where("n > 1"))
    per_text = saved(shingles.join(small(counts), ["width", "h"]).groupBy("key").agg(F.collect_list(F.struct("h", "n")).alias("shared")))
    out = saved(keyed.select("id", "body", "key").join(small(per_text, F.size("shared")), "key", "left").select("id", "body", "shared"))
    release(keyed, counts, per_text)
    return out


def _slices(benchmark: DataFrame, item: str, text: str) -> Iterator[list[Row]]:
    """The distinct items, in runs that tasks may be sent."""
    run, held = [], 0
    items = _with_counts(benchmark, item, text)
    for row in items.toLocalIterator():
        if run and (len(run) >= MAX_ITEMS or held + len(row[1] or "") > MAX_CHARS):
            yield run
            run, held = [], 0
        shared = row[2] or []
        run.append((row[0], row[1], np.array([x[0] for x in shared], dtype=np.int64).view(np.uint64), np.array([x[1] for x in shared], dtype=np.int64)))
        held += len(row[1] or "")
    if run:
        yield run
    release(items)


class Run:
    """Items that tasks are sent together; a Python worker indexes them once, for all its tasks."""

    def __init__(self, rows: list[Row], similarity: float):
        self.rows, self.similarity, self._items = rows, similarity, None

    def items(self) -> Items:
        """Indexed with the counts of the whole benchmark."""
        if self._items is None:
            counts = {}
            for _, body, hs, ns in self.rows:
                if len(hs):
                    w = min(WORDS, len(word_hashes([body])[0]))
                    counts.update(((w, h), n) for h, n in zip(hs.tolist(), ns.tolist()))
            self._items = Items([r[:2] for r in self.rows], WORDS, counts, self.similarity)
        return self._items


MATCHES = "array<struct<item:long,similarity:double>>"


def _searcher(sent: Broadcast):
    kind = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64())]))

    def search(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = sent.value.items()
        for array in arrays:
            got = [m for _, texts in blocks(array) for m in matches(texts, items, sent.value.similarity)]
            order = [sorted(m.items(), key=lambda x: (x[0] is None, x[0])) for m in got]
            yield pa.array([[{"item": i, "similarity": s} for i, s in x] for x in order], kind)

    return search


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    similarity: float = SIMILARITY, column: str = "contamination",
) -> DataFrame:
    """``docs`` with ``column``: array of (item, similarity) of the benchmark items it holds, by item; empty if none.

    An item is held if a window of as many words has a weighted similarity of ``similarity`` or
    more on shingles of five words (items of fewer words: one shingle of all), and a SimHash
    within RADIUS bits. Whole texts are read. Null and empty texts, and items without words, match nothing;
    null item ids are reported as null; a text under several ids is one text and reported under each. A shingle
    weighs 1/n if n texts of the whole benchmark hold it, whatever the runs; what is not of the item weighs as the
    item's shingles do on average. Empty tables give
    an empty column or no rows. Columns of ``docs`` stay, but one named as ``column`` is replaced.
    Documents never move between tasks. The benchmark is read to the driver in runs of at most MAX_ITEMS items or
    MAX_CHARS characters, and each run is a pass over ``docs``; a task holds the index of one run, and between
    passes the table is written, whatever ``text`` is. ``column`` must not be ``text``.
    """
    sc = docs.sparkSession.sparkContext
    out, before = docs.withColumn(column, F.array().cast(MATCHES)), None
    for n, rows in enumerate(_slices(benchmark, item, item_text)):
        found = F.arrow_udf(_searcher(sc.broadcast(Run(rows, similarity))), MATCHES)(F.col(text).cast("string"))
        if n:  # a pass holds one run's index
            now = saved(out)
            release(before)
            out, before = now.withColumn(column, F.array_sort(F.concat(F.col(column), found))), now
        else:
            out = docs.withColumn(column, found)
    return out
