"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are sorted by the grid cells of their leading principal dimensions and cut into tiles. Intervals of that order are joined recursively, eight
to one, each with what bounds it: two intervals that are provably distant are skipped, two that provably link throughout are counted whole, and only tiles that
are neither meet in a task, which does the same with runs of rows before it computes cosines. A cosine of t is a distance of sqrt(2 - 2 t).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import connected_components, small
from kindling.llm.gram import CELLS, gram, matrix, pieces
from kindling.storage import release, saved

MIN_COSINE = 0.95
#: Leading dimensions of the order and bits of a cell's number in each; coordinates that are looked at for them at most.
LEADING, BITS, MAX_DIMS = 12, 5, 1024
#: Bytes and least rows of a tile, tiles that a small table is cut into, rows of a run inside a tile.
TILE_BYTES, TILE_ROWS, FEW_TILES, RUN = 8 << 20, 1024, 24, 256
#: Intervals that make one of the next level, as bits; partners of a tile that share a copy of it.
FAN, PARTNERS = 3, 64
#: Bits of a row's place in its tile.
PLACE = 20


@dataclass(frozen=True)
class Space:
    """The least cosine, and the leading principal axes (columns) of vectors of ``dims``. Others go by their first coordinates: any orthonormal axes keep distances from growing."""

    cosine: float
    dims: int
    axes: np.ndarray

    @property
    def eps(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)

    def coordinates(self, units: np.ndarray) -> np.ndarray:
        """Projections on the axes and, last, the length of what is left: two vectors are no nearer than their coordinates."""
        axes = self.axes if units.shape[1] == self.dims else np.eye(units.shape[1], LEADING)
        p = units[:, : len(axes)] @ axes
        return np.concatenate([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1, keepdims=True)))], axis=1)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """The numbers of the grid cells, most significant dimension first, in one long."""
        width = max(self.eps / 4, 2.001 / (1 << BITS))
        at = np.floor((np.clip(self.coordinates(units)[:, :LEADING], -1, 1) + 1) / width).astype(np.int64)
        return (at << np.arange(BITS * (LEADING - 1), -1, -BITS)).sum(axis=1)

    def distant(self, lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(lo - other_hi, other_lo - hi), 0)
        return (gap * gap).sum(axis=-1) > self.eps**2 + 1e-9

    def joined(self, distance: np.ndarray | float, reach: np.ndarray | float) -> np.ndarray | bool:
        """All pairs link: balls of together ``reach`` around centres ``distance`` apart."""
        return distance + reach < self.eps - 1e-6


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Rows are scaled by their largest entry first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def unite(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Bring the trees of linked rows together; every row points to its root, the least row of its tree."""
    while len(p):
        p, q = parent[p], parent[q]
        apart = p != q
        p, q = p[apart], q[apart]
        if len(p):
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]


class Runs:
    """A tile's unit vectors in runs of RUN rows, with what bounds each run."""

    def __init__(self, raw: np.ndarray, space: Space):
        self.raw, self.units = raw, units(raw)
        self.single = self.units.astype(np.float32)
        at = np.arange(0, len(raw), RUN)
        self.bounds = np.append(at, len(raw))
        self.sizes = np.diff(self.bounds)
        c = space.coordinates(self.units)
        self.lo, self.hi = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
        self.centres = np.add.reduceat(self.units, at) / self.sizes[:, None]
        off = self.units - np.repeat(self.centres, self.sizes, axis=0)
        self.radii = np.sqrt(np.maximum.reduceat((off * off).sum(axis=1), at))


def tile_links(raw: np.ndarray, other: np.ndarray | None, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, root of each row) among the pairs of a row of ``raw`` and one of ``other``, or of ``raw`` alone if ``other`` is None; ``other``'s rows follow ``raw``'s.

    Cosines in single precision decide but for those within their error of the limit, which are computed in double precision, and those within that error exactly.
    """
    a = Runs(raw, space)
    b = a if other is None else Runs(other, space)
    shift = 0 if other is None else len(raw)
    total = len(raw) + (0 if other is None else len(other))
    links, parent = np.zeros(total, dtype=np.int64), np.arange(total)
    margin = (raw.shape[1] + 8) * 2.0**-23
    for i in range(len(a.sizes)):
        first = i if other is None else 0
        rows = np.arange(a.bounds[i], a.bounds[i + 1])
        far = space.distant(a.lo[i], a.hi[i], b.lo[first:], b.hi[first:])
        distance = np.sqrt(((b.centres[first:] - a.centres[i]) ** 2).sum(axis=1))
        whole = space.joined(distance, a.radii[i] + b.radii[first:]) & ~far
        for j in np.flatnonzero(whole) + first:
            own = other is None and i == j
            columns = np.arange(b.bounds[j], b.bounds[j + 1]) + shift
            links[rows] += len(columns) - own
            if not own:
                links[columns] += len(rows)
            every = np.concatenate([rows, columns])
            unite(parent, np.full(len(every), rows[0]), every)
        left = np.flatnonzero(~far & ~whole) + first
        at = np.concatenate([np.arange(b.bounds[j], b.bounds[j + 1]) for j in left]) if len(left) else np.zeros(0, dtype=np.int64)
        for k in range(0, len(at), CELLS // RUN):
            columns = at[k : k + CELLS // RUN]
            x = a.single[rows] @ b.single[columns].T
            p, q = np.nonzero(x >= space.cosine - margin)
            if not len(p):
                continue
            near = x[p, q] <= space.cosine + margin
            p, q = rows[p], columns[q]
            if other is None:
                once = p < q
                p, q, near = p[once], q[once], near[once]
            keep = ~near
            for s in np.array_split(np.flatnonzero(near), max(1, int(near.sum()) * raw.shape[1] // CELLS)):
                cosine = (a.units[p[s]] * b.units[q[s]]).sum(axis=1)
                keep[s] = cosine >= space.cosine
                for e in s[np.abs(cosine - space.cosine) < 1e-12]:
                    keep[e] = exact_cosine(a.raw[p[e]], b.raw[q[e]]) >= space.cosine
            p, q = p[keep], q[keep] + shift
            links += np.bincount(p, minlength=total) + np.bincount(q, minlength=total)
            unite(parent, p, q)
    return links, parent


_BOUNDS = "first long, n long, shortest int, longest int, lo array<double>, hi array<double>, centre array<double>, radius double"


def _tiles(rows: DataFrame, space: Space, kind: str, cell: type, size: int) -> DataFrame:
    """(part, local, ids, data, bounds) of ``rows`` (part, id, v), which come in their order: at most ``size`` rows and TILE_BYTES, of one length."""

    def tile(part: int, local: int, ids: list, lists: list[pa.Array]) -> pa.RecordBatch:
        raw = matrix(pa.concat_arrays(lists), cell)
        u = units(raw)
        c, centre = space.coordinates(u), u.mean(axis=0)
        radius = math.sqrt(((u - centre) ** 2).sum(axis=1).max())
        cells = [part, local, pa.concat_arrays(ids).to_pylist(), raw.tobytes(), len(raw), raw.shape[1], raw.shape[1], c.min(axis=0), c.max(axis=0), centre, radius]
        types = [pa.int32(), pa.int64(), pa.list_(ids[0].type), pa.binary(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3, pa.float64()]
        arrays = [pa.array([x.tolist() if isinstance(x, np.ndarray) else x], t) for x, t in zip(cells, types)]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "local", "ids", "data", "n", "shortest", "longest", "lo", "hi", "centre", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, ids, lists, held, length = 0, 0, [], [], 0, 0
        for batch in batches:
            v, sizes = batch.column(2), np.diff(batch.column(2).offsets.to_numpy())
            at = 0
            while at < len(v):
                if held and (sizes[at] != length or held >= room):
                    yield tile(part, local, ids, lists)
                    local, ids, lists, held = local + 1, [], [], 0
                part, length = batch.column(0)[at].as_py(), int(sizes[at])
                room = max(1, min(size, TILE_BYTES // (length * np.dtype(cell).itemsize)))
                same = np.flatnonzero(sizes[at:] != length)
                n = min(room - held, int(same[0]) if len(same) else len(v) - at)
                ids.append(batch.column(1).slice(at, n))
                lists.append(v.slice(at, n))
                held, at = held + n, at + n
        if held:
            yield tile(part, local, ids, lists)

    shape = f"part int, local long, ids array<{kind}>, data binary, {_BOUNDS.removeprefix('first long, ')}"
    return rows.mapInArrow(run, shape)


def _levels(tiles: DataFrame) -> list[DataFrame]:
    """Bounds (id, ...) of the intervals of each level, tiles first, up to a level of one interval."""
    out = [saved(tiles.selectExpr("number as id", "number as first", *[f.split()[0] for f in _BOUNDS.split(", ")[1:]]))]

    def merged(parts: pa.Table) -> pa.Table:
        n, lo, hi = parts["n"].to_numpy(), matrix(parts["lo"].combine_chunks()), matrix(parts["hi"].combine_chunks())
        shortest, longest = min(parts["shortest"].to_pylist()), max(parts["longest"].to_pylist())
        centre, radius = None, math.inf
        if shortest == longest:
            c = matrix(parts["centre"].combine_chunks())
            centre = (c * n[:, None]).sum(axis=0) / n.sum()
            radius = float((np.sqrt(((c - centre) ** 2).sum(axis=1)) + parts["radius"].to_numpy()).max())
        cells = [parts["id"][0].as_py() >> FAN, min(parts["first"].to_pylist()), int(n.sum()), shortest, longest, lo.min(axis=0).tolist(), hi.max(axis=0).tolist(), None if centre is None else centre.tolist(), radius]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(cells, parts.schema)], schema=parts.schema)

    while out[-1].count() > 1:
        out.append(saved(out[-1].groupBy(F.shiftright("id", FAN)).applyInArrow(merged, f"id long, {_BOUNDS}")))
    return out


def _descend(levels: list[DataFrame], space: Space) -> tuple[DataFrame, DataFrame]:
    """((a, b) of the tiles that have to meet, (level, a, b) of the intervals that link throughout): from the whole order down, an equi-join with the parts of intervals a level."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (dict(zip((f.name for f in batch.schema.field(s).type), batch.column(s).flatten())) for s in ("sa", "sb"))
            far = space.distant(matrix(a["lo"]), matrix(a["hi"]), matrix(b["lo"]), matrix(b["hi"]))
            far |= (a["shortest"].to_numpy() > b["longest"].to_numpy()) | (b["shortest"].to_numpy() > a["longest"].to_numpy())
            reach = a["radius"].to_numpy() + b["radius"].to_numpy()
            verdict = np.where(far, 0, 1)
            for i in np.flatnonzero(~far & (reach < space.eps)):  # one length each, else their radius is infinite
                x, y = np.array(a["centre"][i].as_py()), np.array(b["centre"][i].as_py())
                if len(x) == len(y) and space.joined(float(np.sqrt(((x - y) ** 2).sum())), reach[i]):
                    verdict[i] = 2
            keep = np.flatnonzero(verdict)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(verdict[keep].astype(np.int32))], names=["a", "b", "verdict"])

    spark = levels[0].sparkSession
    bounds = F.struct("shortest", "longest", "lo", "hi", "centre", "radius")
    top = levels[-1].select(F.col("id").alias("pa"), F.col("id").alias("pb"))
    whole = spark.createDataFrame([], "level int, a long, b long")
    for level in [*range(len(levels) - 2, -1, -1)] or [None]:
        if level is None:  # one tile
            return top.select(F.col("pa").alias("a"), F.col("pb").alias("b")), whole
        parts = levels[level].select("id", F.shiftright("id", FAN).alias("up"), bounds.alias("s"))
        a = parts.select(F.col("id").alias("a"), F.col("up").alias("pa"), F.col("s").alias("sa"))
        b = parts.select(F.col("id").alias("b"), F.col("up").alias("pb"), F.col("s").alias("sb"))
        judged = saved(top.join(a, "pa").join(b, "pb").where("a <= b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long, verdict int"))
        top = judged.where("verdict = 1").select(F.col("a").alias("pa"), F.col("b").alias("pb"))
        whole = whole.union(judged.where("verdict = 2").select(F.lit(level), "a", "b"))
    return top.select(F.col("pa").alias("a"), F.col("pb").alias("b")), saved(whole)


def _meet(pairs: DataFrame, tiles: DataFrame, space: Space, cell: type) -> DataFrame:
    """(node, links, root) of the rows that link in a pair of tiles. A tile with many partners is dealt to several tasks, PARTNERS of them at a time."""
    # Either tile of a pair goes first by turns: else the last of the order would meet all others in one task.
    pairs = saved(pairs.select(F.when((F.col("a") + F.col("b")) % 2 == 0, F.struct(F.col("a").alias("x"), F.col("b").alias("y"))).otherwise(F.struct(F.col("b").alias("x"), F.col("a").alias("y"))).alias("p")).select("p.x", "p.y"))
    out = pairs
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for side in ("x", "y"):
        shares = saved(pairs.groupBy(side).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares")))
        dealt = out.join(small(shares), side).withColumn("share", F.pmod(F.xxhash64("x", "y"), "shares").cast("int")).drop("shares")
        data = tiles.select(F.col("number").alias(side), F.col("longest").alias("length"), F.col("data").alias(f"data_{side}"))
        copies = data.join(small(shares), side).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        # By number, or adaptive execution would join in a few tasks what is few bytes and much work.
        out = dealt.repartition(spread, side, "share").join(copies if side == "x" else copies.drop("length"), [side, "share"]).drop("share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, length, one, two in zip(*(batch.column(c) for c in ("x", "y", "length", "data_x", "data_y"))):
                x, y, length = x.as_py(), y.as_py(), length.as_py()
                raw, other = (np.frombuffer(d.as_buffer(), dtype=cell).reshape(-1, length) for d in (one, two))
                links, root = tile_links(raw, None if x == y else other, space)
                node = np.arange(len(raw)) + (x << PLACE)
                if x != y:
                    node = np.concatenate([node, np.arange(len(other)) + (y << PLACE)])
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(node[root[at]])], names=["node", "links", "root"])

    return out.select("x", "y", "length", "data_x", "data_y").mapInArrow(run, "node long, links long, root long")


def _whole_links(whole: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((number, links of each of its rows), (number, tile that it is linked with)) of the tiles under intervals that link throughout."""
    tiles = levels[0].select(F.col("id").alias("number"))
    links = edges = None
    for level, nodes in enumerate(levels):
        size = nodes.select("id", "n", "first")
        here = whole.where(F.col("level") == level)
        both = here.join(size.toDF("a", "na", "fa"), "a").join(size.toDF("b", "nb", "fb"), "b")
        own = F.col("a") == F.col("b")
        sides = both.select(F.col("a").alias("id"), F.when(own, F.col("na") - 1).otherwise(F.col("nb")).alias("links"), F.col("fa").alias("to"))
        sides = sides.union(both.where(~own).select("b", "na", "fa"))
        under = tiles.withColumn("id", F.shiftright("number", FAN * level)).join(sides, "id")
        links = under.select("number", "links") if links is None else links.union(under.select("number", "links"))
        edges = under.select("number", "to") if edges is None else edges.union(under.select("number", "to"))
    return saved(links.groupBy("number").agg(F.sum("links").alias("links"))), saved(edges.distinct())


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = MIN_COSINE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(``key``, n_links, component_id, kept) for each row: how many other rows have a cosine of at least ``cosine`` with it, the least ``key`` that links reach, and whether that is its own.

    Every row is a vector: repeated rows link with each other. Vectors that are null, empty or zero, or that hold null or non-finite entries, link with
    nothing, nor do vectors of unlike length. A null key is reached but is no component's id unless all its keys are null; then every such row is kept. An
    empty table gives no rows; other columns are not read.

    Nothing is approximate: intervals are skipped or counted whole by bounds that hold for all their rows. No pair of rows is emitted: a pair of tiles gives a count and a root
    for each row that links in it. A group of copies that is provably one is counted by intervals, in steps that grow with its tiles' logarithm.
    """
    kind, element = vectors.schema[key].dataType.simpleString(), vectors.schema[column].dataType.elementType.simpleString()
    cell = np.float32 if element == "float" else np.float64
    v = F.col(column) if element == "float" else F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    usable = rows.where(fine)
    lengths = usable.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max(F.struct("n", "dims")).alias("most"), F.sum("n").alias("n")).first()
    others = rows.where(~fine).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if common["n"] is None:
        return others
    count, dims = common["n"], common["most"]["dims"]
    lead = min(dims, MAX_DIMS)
    n, sums, g = gram(usable.where(F.size("v") == dims).select("v"), lead, lambda x: units(x)[:, :lead])
    _, axes = np.linalg.eigh(g / n - np.outer(sums / n, sums / n))
    axes = np.concatenate([axes[:, ::-1][:, :LEADING], np.zeros((lead, max(0, LEADING - lead)))], axis=1)
    space = Space(cosine, dims, axes)

    def cells(lists: pa.Array) -> pa.Array:
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros(len(sizes), dtype=np.int64)
        for length in np.unique(sizes):
            at = np.flatnonzero(sizes == length)
            for start, part in pieces(lists.take(pa.array(at)), int(length)):
                out[at[start : start + len(part)]] = space.cells(units(matrix(part)))
        return pa.array(out)

    size = max(tile_rows, -(-count // FEW_TILES))
    most = max(1, min(size, TILE_BYTES // (dims * np.dtype(cell).itemsize)))
    # Equal vectors are told apart by their place in the input, so that a hot one fills many tiles.
    order = usable.select("id", "v", F.size("v").alias("length"), F.arrow_udf(cells, "long")("v").alias("cell"), F.xxhash64("v").alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = order.repartitionByRange(-(-count // (2 * most)), "length", "cell", "tie", "place").sortWithinPartitions("length", "cell", "tie", "place")
    cut = saved(_tiles(order.select(F.spark_partition_id().alias("part"), "id", "v"), space, kind, cell, size))
    bits = int(cut.agg(F.max("local")).first()[0]).bit_length()
    tiles = cut.withColumn("number", F.shiftleft(F.col("part").cast("long"), bits) + F.col("local"))
    levels = _levels(tiles)
    pairs, whole = _descend(levels, space)
    met = saved(_meet(pairs, tiles, space, cell))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    edges = met.select(F.col("node").alias("a"), F.col("root").alias("b"))
    placed = tiles.select("number", F.posexplode("ids").alias("at", "id")).select("number", (F.shiftleft("number", PLACE) + F.col("at")).alias("node"), "id")
    out = placed.join(links, "node", "left")
    if not whole.isEmpty():
        of_tile, between = _whole_links(whole, levels)
        heads = F.shiftleft("number", PLACE)
        edges = edges.union(between.select(heads, F.shiftleft("to", PLACE))).union(placed.join(small(of_tile.select("number")), "number", "left_semi").select("node", heads))
        out = out.join(small(of_tile.withColumnRenamed("links", "more")), "number", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0)))
    labels = saved(connected_components(edges)).withColumnRenamed("id", "node")
    release(*levels)
    out = out.join(labels, "node", "left")
    least = saved(out.where("component is not null").groupBy("component").agg(F.min("id").alias("least")))
    own = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least"))
    out = out.join(small(least), "component", "left")
    return others.union(out.select("id", F.coalesce("links", F.lit(0)).cast("long"), own, F.col("id").eqNullSafe(own)))
