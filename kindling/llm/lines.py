"""Line dedup: fuzzy lines by MinHash over character shingles, banding, exact Jaccard
verification and distributed union-find; one line of each component stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import blocks, connected_components, free_name, mixed, pairs_of_buckets, small
from kindling.storage import release, saved

#: Characters of a shingle; lines at this Jaccard or more are the same line.
WIDTH, SIMILARITY = 8, 0.8
#: Bands of rows: a pair at 0.8 shares none with probability (1 - 0.8^4)^10 = 0.005, at 0.85 0.0006.
BANDS, ROWS = 10, 4
#: Lines of a bucket that are compared in one task, and the characters beyond which a line counts as several; a task holds two such parts.
BUCKET, LINE = 512, 4096
#: Parts of lines outside a bucket's largest component beyond which the bucket is dealt by rare shingles first: about as many as a line has.
SPREAD = 16
#: Shingles of a line that are compared as strings at once.
PART = 200_000

#: Characters hashed at once: their arrays stay in a core's cache.
LINE_CHARS = 60_000
#: Odd factors turn the 32-bit hashes of a line's shingles into as many orders.
_FACTORS = np.random.default_rng(20).integers(0, 1 << 32, 512, dtype=np.uint32) | np.uint32(1)


def normal(line: str) -> str:
    """How lines are compared: lower case, runs of white space as one space, none at the ends."""
    x = line.lower()
    if x.isprintable() and "  " not in x and x[:1] != " " and x[-1:] != " ":  # the space is the only white space that is printable
        return x
    return " ".join(x.split())


def _windows(points: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of the ``width`` characters from each on, from those of half the width."""
    if width == 1:
        return points
    half = width // 2
    part = _windows(points, half)
    n = len(points) - width + 1
    h = part[:n] * np.uint64(pow(0x9E3779B97F4A7C15, half, 1 << 64))
    h += part[half : half + n]
    if width % 2:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[width - 1 :]
    return h


def hashed_shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the shingle from each character on, first and one-past-last of each line; a short line is one shingle)."""
    padded = [x if len(x) >= width else x.ljust(width, "\0") for x in lines]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in padded])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return _windows(points, width), starts, starts + sizes - width + 1


def line_hashes(lines: list[str], width: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each non-empty normal line, its band keys)."""
    h, starts, ends = hashed_shingles(lines, width)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h >>= np.uint64(32)
    short = h.astype(np.uint32)
    # What reaches from a line into the next one counts as the line's first shingle, so that a line ends where the next begins.
    short[ends[:-1, None] + np.arange(width - 1)] = short[starts[:-1], None]
    turned = np.empty_like(short)
    least = np.empty((bands * rows, len(lines)), dtype=np.uint64)
    for i in range(bands * rows):
        np.multiply(short, _FACTORS[i], out=turned)
        least[i] = np.minimum.reduceat(turned, starts)
    least = least.reshape(bands, rows, len(lines))
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for r in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
    whole = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    return np.array(whole, dtype=np.uint64), np.ascontiguousarray(keys.T)


def _texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tie, body): null keys share the least long, null texts are empty; tie is a hash of the text, by which rows of one key are told apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return rows.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(body).alias("tie"), body.alias("body"))


def hashed_lines(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, tie, line_no, h, bands) for every line of ``docs`` (doc, tie, body) that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in blocks(batch.column(2), LINE_CHARS):
                lines, owner, number = [], [], []
                for i, text in enumerate(texts):
                    for j, line in enumerate(text.split("\n")):
                        if x := normal(line):
                            lines.append(x)
                            owner.append(first + i)
                            number.append(j)
                if not lines:
                    continue
                h, keys = line_hashes(lines, width, bands, rows)
                values = pa.array(keys.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, bands, dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner]), pa.array(ties[owner]), pa.array(number, pa.int32()), pa.array(h.view(np.int64)), lists],
                    names=["doc", "tie", "line_no", "h", "bands"],
                )

    return docs.mapInArrow(run, "doc long, tie long, line_no int, h long, bands array<long>")


def _wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line): the normal text of ``wanted`` (doc, tie, line_no, h) lines."""
    per_doc = saved(wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("line_no", "h")).alias("lines")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, texts = [], []
            for text, lines in zip(batch.column(0), batch.column(1)):
                parts = text.as_py().split("\n")
                for x in lines.as_py():
                    if x["line_no"] < len(parts):
                        hs.append(x["h"])
                        texts.append(normal(parts[x["line_no"]]))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(texts, pa.string())], names=["h", "line"])

    return docs.join(small(per_doc, F.size("lines")), ["doc", "tie"]).select("body", "lines").mapInArrow(run, "h long, line string")


def _numbered(points: np.ndarray, bound: int, width: int) -> tuple[np.ndarray, int]:
    """(numbers of the ``width`` points from each on, equal for equal points only; what they are below). ``points`` are below ``bound``."""
    if width == 1:
        return points, bound
    half, n = width // 2, len(points) - width + 1
    part, most = _numbered(points, bound, half)
    last = bound if width % 2 else 1
    if most * most * last > 1 << 64:
        kinds, part = np.unique(part, return_inverse=True)
        part, most = part.astype(np.uint64), len(kinds)
    out = part[:n] * np.uint64(most) + part[half : half + n]
    if width % 2:
        out = out * np.uint64(bound) + points[width - 1 :]
    return out, most * most * last


def _different(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """What is different of each span of ``numbers``, in order; the spans are sorted in place."""
    spans = [numbers[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    for x in spans:
        x.sort()
    new = np.append(True, numbers[1:] != numbers[:-1])
    new[starts] = True
    return [x[new[a:b]] for x, a, b in zip(spans, starts.tolist(), ends.tolist())]


def numbered_shingles(lines: list[str], width: int) -> list[np.ndarray]:
    """The different shingles of each line as numbers in order, equal in all ``lines`` for equal shingles only; a short line is one shingle."""
    if not lines:
        return []
    text = "".join(lines)
    pad = next(c for c in map(chr, range(0x110000)) if c not in text)
    padded = [x if len(x) >= width else x.ljust(width, pad) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    there = np.zeros(int(codes.max()) + 1, dtype=bool)
    there[codes] = True
    rank = np.cumsum(there).astype(np.uint64) - np.uint64(1)
    numbers, _ = _numbered(rank[codes], int(there.sum()), width)
    sizes = np.array([len(x) for x in padded])
    starts = np.cumsum(sizes) - sizes
    return _different(numbers, starts, starts + sizes - width + 1)


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingles(line: str, width: int) -> set[str]:
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of numbers, each in order and without repeats, have at least ``similarity``."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared / (len(both) - shared) >= similarity


def similar(x: str, y: str, width: int, similarity: float) -> bool:
    """Whether two lines have at least ``similarity``, exactly. Shingles of very long lines are compared by parts, those of
    one hash in the same part, so that a line takes a number per character and the strings of one part."""
    parts = -(-max(len(x), len(y)) // PART)
    if parts <= 1:
        return alike(*numbered_shingles([x, y], width), similarity)
    part_of = [(mixed(hashed_shingles([line], width)[0]) % np.uint64(parts)).astype(np.uint32) for line in (x, y)]
    both = either = 0
    for part in range(parts):
        a, b = ({line[i : i + width] for i in np.flatnonzero(of == part).tolist()} for line, of in zip((x, y), part_of))
        both += len(a & b)
        either += len(a | b)
    return both / either >= similarity


def _keep_alike(keep: np.ndarray, some: list[str], at: list[tuple[int, int, int]], width: int, similarity: float) -> None:
    """Mark the rows of ``at`` (row, places of two lines in ``some``) whose lines have at least ``similarity``."""
    sets = numbered_shingles(some, width)
    for row, x, y in at:
        keep[row] = alike(sets[x], sets[y], similarity)


def _verified(pairs: DataFrame, lines: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose lines have at least ``similarity``, by the lines themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            some, at, held = [], [], 0  # lines, (row, place of its two lines)
            for row, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.as_py(), y.as_py()
                if max(len(x), len(y)) > PART:
                    keep[row] = similar(x, y, width, similarity)
                    continue
                if not at or some[at[-1][1]] != x:
                    some.append(x)
                    left = len(some) - 1
                some.append(y)
                at.append((row, left, len(some) - 1))
                held += len(x) + len(y)
                if held > LINE_CHARS:
                    _keep_alike(keep, some, at, width, similarity)
                    some, at, held = [], [], 0
            _keep_alike(keep, some, at, width, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    with_b = pairs.join(lines.select(F.col("h").alias("b"), F.col("line").alias("y")).hint("merge"), "b")
    both = with_b.join(lines.select(F.col("h").alias("a"), F.col("line").alias("x")).hint("merge"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _shared(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """How many elements ``some`` of the sets share with each: products of incidence columns, a stretch of the elements at a time."""
    values = np.concatenate(sets)
    order = np.argsort(values)
    values = values[order]
    same = values[1:] == values[:-1]
    often = np.append(same, False) | np.append(False, same)
    number = np.cumsum(np.append(True, ~same)[often]) - 1  # what one set only has needs no column
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order][often]
    out = np.zeros((len(some), len(sets)), dtype=np.float32)
    step = min(4096, int(number[-1]) + 1) if len(number) else 1
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(number, [low, low + step])
        x = np.zeros((len(sets), step), dtype=np.float32)
        x[owner[a:b], number[a:b] - low] = 1
        out += x[some] @ x.T
    return out


def bucket_links(hs: list[int], components: list[int], lines: list[str], width: int, similarity: float, rest: list[bool] | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect what of a bucket hangs together, beyond ``components``: exact Jaccard of all its lines at once.
    ``rest``: lines of which one at least is in every pair that matters; all by default."""
    if len(hs) <= 6:
        brief = [i for i, x in enumerate(lines) if len(x) <= PART]
        sets = dict(zip(brief, numbered_shingles([lines[i] for i in brief], width)))
        for j in range(1, len(hs)):
            for i in range(j):
                if components[i] == components[j]:
                    continue
                if alike(sets[i], sets[j], similarity) if i in sets and j in sets else similar(lines[i], lines[j], width, similarity):
                    yield hs[i], hs[j]
        return
    sets = []
    for _, some in blocks(pa.array(lines)):
        sets.extend(_different(*hashed_shingles(some, width)))
    size = np.array([len(x) for x in sets])
    group = np.unique(components, return_inverse=True)[1]
    some = np.arange(len(hs)) if rest is None else np.flatnonzero(rest)
    both = _shared(sets, some)
    near = both >= similarity * (size[some][:, None] + size[None, :] - both) - 1e-4
    for row, i in zip(near, some.tolist()):
        for j in np.flatnonzero(row & (group != group[i])).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                yield hs[i], hs[j]


def _several(at: DataFrame) -> DataFrame:
    """(key, n, main, rest) of the buckets of ``at`` (key, h, component, w) that hold several components: weight of all lines, the component
    of most weight, and the weight of all others. Added up by component first, so that a hot bucket is not gathered."""
    by_component = at.groupBy("key", "component").agg(F.sum("w").alias("m"))
    most = F.max(F.struct("m", (-F.col("component")).alias("minus")))
    sizes = by_component.groupBy("key").agg(F.sum("m").alias("n"), F.count("*").alias("components"), most.alias("most")).where("components > 1")
    return sizes.select("key", "n", (-F.col("most.minus")).alias("main"), (F.col("n") - F.col("most.m")).alias("rest"))


def _by_rare_shingle(at: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The lines of ``at`` (key, h, component) dealt into finer buckets: by those of their shingles that are rarest in their bucket, as many
    as two lines of ``similarity`` cannot all lack. Lines that only share what the whole bucket has do not meet; no link is lost."""
    last = F.greatest(F.length("line") - F.lit(width - 1), F.lit(1))
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(F.col("line"), i, F.lit(width)))))
    shingles_ = saved(at.join(texts.select("h", cut.alias("s")).hint("merge"), "h").select("key", "h", "component", F.size("s").alias("n"), F.explode("s").alias("s")))
    held = saved(shingles_.groupBy("key", "s").agg(F.count("*").alias("df")).where("df > 1"))
    shared = shingles_.join(held.hint("merge"), ["key", "s"]).groupBy("key", "h", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("s"))
    # What no other line of the bucket has stands first in the order by rarity.
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1 - (F.col("n") - F.size("s"))
    rare = saved(shared.select("key", "h", "component", F.explode(F.slice("s", F.lit(1), F.greatest(prefix, F.lit(0)))).alias("s")))
    release(shingles_, held)
    return rare.select(F.xxhash64("key", F.col("s.s")).alias("key"), "h", "component")


def _open_links(large: DataFrame, labels: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """(a, b): links between lines that share a bucket of ``large`` and are not connected yet; None if no bucket can hold one.

    Only buckets of several components are looked at. Lines of a bucket are compared in one task, without a row per pair; in one of over
    BUCKET lines (a long one counts as one for each LINE characters) those outside its largest component are dealt into parts, all are dealt
    into parts, and each two parts meet in a task: a line is copied once for each part of the open ones. Where these are more than SPREAD parts, lines are first dealt by their rare shingles.
    """
    weights = small(texts.select("h", F.ceil(F.length("line") / F.lit(LINE)).cast("long").alias("w")).where("w > 1"))
    weighed = lambda rows: rows.join(weights, "h", "left").fillna(1, ["w"])
    at = large.join(small(labels.withColumnRenamed("id", "h")), "h", "left").select("key", "h", F.coalesce("component", "h").alias("component"))
    at = saved(weighed(at))
    open_ = saved(_several(at))
    if open_.isEmpty():
        return None
    most = SPREAD * BUCKET
    hot = open_.where(F.col("rest") > most)
    members = at.join(small(open_.where(F.col("rest") <= most).select("key")), "key")
    if not hot.isEmpty():
        finer = _by_rare_shingle(at.join(F.broadcast(hot.select("key")), "key") if hot.count() <= BUCKET else at.join(hot.select("key"), "key"), texts, width, similarity)
        members = members.select("key", "h", "component").union(finer)
        members = saved(weighed(members.select("key", "h", "component").distinct()))
        open_ = saved(_several(members))
    parts = F.ceil(F.col("n") / F.lit(BUCKET)).cast("long").alias("parts"), F.ceil(F.col("rest") / F.lit(BUCKET)).cast("long").alias("rests")
    both = members.join(small(open_), "key").select("key", "h", "component", "main", *parts)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = both.select("key", "h", "component", F.lit(False).alias("rest"), F.pmod(F.xxhash64("h"), F.col("parts")).alias("i"), upto("rests").alias("j"))
    rest = both.where("component <> main").select("key", "h", "component", F.lit(True).alias("rest"), upto("parts").alias("i"), F.pmod(F.xxhash64("h"), F.col("rests")).alias("j"))
    dealt = every.union(rest).groupBy("key", "h", "component", "i", "j").agg(F.max("rest").alias("rest"))
    whole = dealt.join(texts.hint("merge"), "h").groupBy("key", "i", "j").agg(F.collect_list(F.struct("h", "component", "line", "rest")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for bucket in batch.column(0):
                columns = bucket.values
                h, component, line, rest = (columns.field(c).to_pylist() for c in range(4))
                links.extend(bucket_links(h, component, line, width, similarity, rest))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return whole.select("lines").mapInArrow(run, "a long, b long").distinct()


def line_components(docs: DataFrame, lines: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame | None:
    """(id, component) of the line hashes that are linked to another; None if there are none.

    Candidates of a band are verified against its least line first; then buckets that are still in
    several components are compared whole, so that no link of a band is lost and a large group of near copies costs
    one pair per line and band.
    """
    members = lines.select(F.explode("bands").alias("key"), "h")
    pairs, large = pairs_of_buckets(members, "key", "h")
    nodes = saved(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(large.select("h")).distinct())
    if nodes.isEmpty():
        return None
    found = (
        lines.select("doc", "line_no", "tie", "h").join(small(nodes), "h")
        .groupBy("h").agg(F.min(F.struct("doc", "line_no", "tie")).alias("at")).select("h", "at.doc", "at.tie", "at.line_no")
    )
    # A text may stand in several rows; a line is kept once.
    texts = saved(_wanted_lines(docs, found).groupBy("h").agg(F.min("line").alias("line")))
    links = saved(_verified(pairs, texts, width, similarity))
    release(pairs, nodes)
    labels = connected_components(links)  # none of the stars may hold, and yet others of their bucket
    more = _open_links(large, labels, texts, width, similarity)
    more = None if more is None else saved(more)
    release(texts)
    if more is not None and not more.isEmpty():
        labels = connected_components(links.union(more))
    return None if labels.isEmpty() else labels


def dropped_lines(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, tie, dropped array of line numbers) for the rows of ``docs`` (doc, tie, body) that lose lines."""
    lines = saved(hashed_lines(docs, width, bands, rows))
    labels = line_components(docs, lines, width, similarity)
    at = lines.select("doc", "line_no", "tie", "h")
    if labels is None:
        at = at.withColumnRenamed("h", "component")
    else:
        at = at.join(small(labels.withColumnRenamed("id", "h")), "h", "left").select("doc", "line_no", "tie", F.coalesce("component", "h").alias("component"))
    first = saved(at.groupBy("component").agg(F.min(F.struct("doc", "line_no", "tie")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    gone = at.join(small(first), "component").where(F.struct("doc", "line_no", "tie") != F.col("first"))
    out = saved(gone.groupBy("doc", "tie").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")))
    release(lines, first)
    return out


def kept_text(text: Column, dropped: Column) -> Column:
    parts = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(dropped, i))
    return F.when(dropped.isNull(), text).otherwise(F.array_join(parts, "\n"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS, column: str = "dropped_lines",
) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and ``column`` (numbers from 0 of the lines that went, or null).

    Lines are what stands between line feeds, compared in lower case with white space as one space.
    Lines linked directly or through others, across all documents and inside one, are one line; the
    first by (``key``, line number, hash of the text) stays. Links: equal lines, and lines whose character shingles
    have a Jaccard of ``similarity`` or more among the pairs that share a band. Lines shorter than
    ``width`` are one shingle; blank lines stay and link to nothing. A null text stays null, an
    empty one empty; a document that loses all lines keeps its row with an empty text. Rows of
    one ``key`` (null is one key) and text share their decisions, so that a repeated row stays as its twin does; unlike texts of
    one key are judged apart. An empty table gives no rows. All columns of ``docs`` are kept, whatever their names, but one named as ``column``
    is replaced. Two different lines with one 64-bit hash (expected once in 10^9.6 lines) would count as equal.
    """
    gone = dropped_lines(_texts(docs, key, text), width, similarity, bands, rows)
    doc, tie, dropped = (free_name(c, docs) for c in ("doc_", "tie_", "dropped_"))
    gone = gone.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("dropped").alias(dropped))
    same = (F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))) == F.col(doc)) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == F.col(tie))
    out = docs.join(small(gone, F.size(dropped)), same, "left")
    return out.withColumn(text, kept_text(F.col(text), F.col(dropped))).withColumn(column, F.col(dropped)).drop(doc, tie, dropped)
