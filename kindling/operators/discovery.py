"""Finding problems in reactions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.functions import free_name, parts, tokens
from kindling.operators.pivots import DRAWN, MAX_PIVOTS, RINGS, Cells, Tiles, farthest_first
from kindling.storage import saved

#: Query vectors that are compared at once; cosines that a task holds at once; most rows of a tile of a larger search.
MAX_QUERIES, MAX_CELLS, TILE_ROWS = 4096, 1 << 22, 50_000
#: Tiles of a larger search, while none is over TILE_ROWS; a tile of fewer rows than LEAST_ROWS is not worth the queries that are sent to it.
TILES, LEAST_ROWS = 64, 1024


def _terms(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` and ``term``, a row for each token of ``text``."""
    return df.select(*keep, F.explode(parts(F.col(text))).alias("term")).where("term <> ''")


def match_problem_terms(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, problem_id, hits, terms): how often, and with how many different terms, a document names a problem.

    ``lexicon``: (problem_id, term), lower-case tokens, distinct. Words meet it before anything is shuffled where Spark broadcasts it by its size."""
    named = _terms(docs, text, F.col(key)).join(lexicon, "term").groupBy(key, "problem_id", "term").agg(F.count("*").alias("n"))
    return named.groupBy(key, "problem_id").agg(F.sum("n").alias("hits"), F.count("*").alias("terms"))


def place_reactions(reactions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``reactions`` with the problem that their text names most where they have none: by hits, different terms, least id.

    A text that names none, or a null one, leaves it null. Texts are told apart by a digest, so that they do not move; reactions that have a problem are not joined."""
    mark, placed = free_name("digest", reactions), free_name("placed", reactions)
    open_ = F.col("problem_id").isNull() & F.col("text").isNotNull()
    nameless = reactions.where(open_).withColumn(mark, F.md5("text"))
    best = match_problem_terms(nameless, lexicon, mark).groupBy(mark).agg(F.max(F.struct("hits", "terms", (-F.col("problem_id")).alias("minus"))).alias("best"))
    best = best.select(mark, (-F.col("best.minus")).cast("int").alias(placed))
    found = nameless.join(best, mark, "left").withColumn("problem_id", F.col(placed)).select(*[F.col(f"`{c}`") for c in reactions.columns])
    return reactions.where(~open_).union(found)


def problem_terms(docs: DataFrame, k: int = 10, text: str = "text", source: str = "source") -> DataFrame:
    """(source, term, tf, score, rank): the ``k`` terms of each source that stand out by tf * ln(sources / sources with the term).

    Texts are split once; a term's sources are counted on the table of counts. A null source is one source."""
    tf = _terms(docs, text, F.col(source).alias("source")).groupBy("source", "term").agg(F.count("*").alias("tf"))
    spread = F.count("*").over(Window.partitionBy("term"))
    sources = docs.select(F.col(source)).distinct().agg(F.count("*").alias("sources"))
    scored = tf.withColumn("df", spread).join(F.broadcast(sources))  # one row
    scored = scored.select("source", "term", "tf", F.round(F.col("tf") * F.ln(F.col("sources").cast("double") / F.col("df")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def cluster_reactions(vectors: DataFrame, k: int = 10, seed: int = 7, key: str = "vec_id") -> DataFrame:
    """(``key``, cluster) by MLlib's k-means on the unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select(key, F.col("prediction").cast("long").alias("cluster"))


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(problem_id, embedding): the mean vector of each label."""
    cells = vectors.select(F.col(label).alias("problem_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))
    means = cells.groupBy("problem_id", "at").agg(F.avg("x").alias("x"))
    return means.groupBy("problem_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("embedding"))


def _vectors(df: DataFrame, key: str, name: str) -> DataFrame:
    """(``name``, v) of the rows that can be compared: a key, and a vector that is neither null nor empty and holds finite numbers only."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias(name), v.alias("v")).where(F.col(name).isNotNull() & (F.size("v") > 0))
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Unit vectors of lists of one length; a zero vector stays zero and has cosine 0 with all."""
    v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _groups(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which rows, their unit vectors): vectors of unlike lengths do not meet."""
    sizes = np.diff(lists.offsets.to_numpy())
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, _matrix(lists.take(pa.array(at)))


def _by_length(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, unit vectors)."""
    ids = ids.to_numpy(zero_copy_only=False)
    for n, at, unit in _groups(lists):
        yield n, ids[at], unit


class Best:
    """The ``k`` best rows of each query among those seen so far; equal cosines (to six places) go to the lesser row key."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.rows = np.zeros((len(ids), 0), dtype=np.int64)
        self.cosines = np.zeros((len(ids), 0))

    def see(self, rows: np.ndarray, vectors: np.ndarray) -> None:
        """In slices of so many rows that cosines stay within MAX_CELLS."""
        step = max(1, MAX_CELLS // max(1, len(self.ids)))
        for a in range(0, len(rows), step):
            keys, x = rows[a : a + step], self.vectors @ vectors[a : a + step].T
            keys, x = self._top(np.broadcast_to(keys, x.shape), x, np.argsort(np.argsort(keys, kind="stable"), kind="stable"))
            keys, x = np.concatenate([self.rows, keys], axis=1), np.concatenate([self.cosines, x], axis=1)
            self.rows, self.cosines = self._top(keys, x, np.argsort(np.argsort(keys, axis=1, kind="stable"), axis=1, kind="stable"))

    def _top(self, rows: np.ndarray, cosines: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best columns of each row, by whole numbers that no two columns share: the cosine, then the ``place`` of the row key."""
        order = np.rint(np.round(cosines, 6) * -1e6).astype(np.int64) * (1 << 32) + place
        n = min(self.k, rows.shape[1])
        at = np.argpartition(order, n - 1, axis=1)[:, :n] if n < rows.shape[1] else np.broadcast_to(np.arange(n), order.shape)
        return np.take_along_axis(rows, at, axis=1), np.take_along_axis(cosines, at, axis=1)

    def batch(self) -> pa.RecordBatch:
        n = self.rows.shape[1]
        columns = [pa.array(np.repeat(self.ids, n)), pa.array(self.rows.ravel()), pa.array(self.cosines.ravel())]
        return pa.RecordBatch.from_arrays(columns, names=["query", "row", "cosine"])


_FOUND = "query long, row long, cosine double"


def nearest(rows: DataFrame, row_key: str, queries: DataFrame, query_key: str, k: int) -> DataFrame:
    """(query, row, cosine): for each query vector the ``k`` best rows of every task; exact. What is left for the caller is a top-k
    over ``k`` rows per task and query. Equal cosines go to the lesser row key.

    Up to MAX_QUERIES queries, which are counted, go to the tasks and rows stay where they are. More are searched by
    :func:`search`. Null keys, null, empty or ragged vectors and such with a null, NaN or infinity inside match nothing (vectors of unlike
    length do not meet). A zero vector has cosine 0 with all.
    """
    rows, queries = _vectors(rows, row_key, "row"), _vectors(queries, query_key, "query")
    n = queries.count()
    if n > MAX_QUERIES:
        return search(rows, queries, k)
    ids, lists = queries.toArrow().combine_chunks().columns if n else (pa.chunked_array([], pa.int64()), pa.chunked_array([], pa.list_(pa.float64())))
    sent = rows.sparkSession.sparkContext.broadcast(list(_by_length(ids.combine_chunks(), lists.combine_chunks())) if n else [])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {length: Best(q, v, k) for length, q, v in sent.value}
        for batch in batches:
            for length, keys, v in _by_length(batch.column(0), batch.column(1)):
                if length in best:
                    best[length].see(keys, v)
        yield from (b.batch() for b in best.values())

    return rows.mapInArrow(look, _FOUND)


def _cells_of(rows: DataFrame, n: int) -> tuple[Cells, int]:
    """(cells about pivots, rows that a tile may have) for ``n`` ``rows``. Pivots come from a sample of fixed size, drawn by a hash; they
    decide what is compared, not what is found."""
    each = min(TILE_ROWS, max(min(LEAST_ROWS, TILE_ROWS), -(-n // TILES)))
    wanted = min(MAX_PIVOTS, max(2, -(-n // each)))
    drawn = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("row"), "row").limit(wanted * DRAWN).select("v").toArrow().combine_chunks()
    lists = drawn.column(0).combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float64()))
    return Cells({length: farthest_first(unit, wanted) for length, _, unit in _groups(lists)}), each


def _tiled(rows: DataFrame, cells: Cells, each: int) -> tuple[DataFrame, Tiles]:
    """(``rows`` with ``tile``, the tiles): a cell is cut into rings at quantiles of the angle to its pivot, and what is still over ``each``
    rows, many copies say, by a hash. The driver gets four numbers of each ring, of which there are at most RINGS a pivot."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for length, at, unit in _groups(batch.column(1)):
                cell[at], angle[at] = sent.value.place(length, unit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle), pa.array(np.arange(batch.num_rows))], names=["row", "v", "cell", "angle", "deal"])

    placed = saved(rows.mapInArrow(place, "row long, v array<double>, cell long, angle double, deal long"))
    cuts = placed.groupBy("cell").agg(F.percentile_approx("angle", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
    cuts = saved(cuts.select("cell", F.array_distinct("cuts").alias("cuts")))
    ring = F.size(F.filter("cuts", lambda x: x < F.col("angle"))).alias("ring")
    ringed = placed.join(F.broadcast(cuts), "cell").select("row", "v", "cell", "angle", "deal", ring)  # a row for each cell
    sizes = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    cell, count, least, most, at = [], [], [], [], []
    for r in sorted(sizes.collect()):
        pieces = -(-r.n // each)
        at.append((r.cell, r.ring, len(cell), pieces))
        for piece in range(pieces):
            cell.append(r.cell)
            count.append(r.n // pieces)  # about so many; what it is used for need not be exact
            least.append(r.least)
            most.append(r.most)
    known = rows.sparkSession.createDataFrame(at, "cell long, ring int, first int, pieces int")
    tile = (F.col("first") + F.pmod(F.xxhash64("row", "deal"), F.col("pieces"))).cast("int")
    return ringed.join(F.broadcast(known), ["cell", "ring"]).select("row", "v", tile.alias("tile")), Tiles(cells, cell, count, least, most)


def _visits(queries: DataFrame, tiles: Tiles, k: int) -> DataFrame:
    """(query, v, seen, tiles, deal) of ``queries``: ``tiles`` to see first or, if ``queries`` have ``seen`` and ``least``, those to see besides."""
    sent, later = queries.sparkSession.sparkContext.broadcast(tiles), "least" in queries.columns
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MAX_CELLS // max(1, len(sent.value.cell)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                out: list = [()] * batch.num_rows
                seen = batch.column(2).to_pylist() if later else out
                for length, at, unit in _groups(batch.column(1)):
                    if later:
                        least = batch.column(3).to_numpy(zero_copy_only=False)[at]
                        got = sent.value.later_visits(length, unit, least, [np.array(seen[i], dtype=np.int64) for i in at])
                    else:
                        got = sent.value.first_visits(length, unit, k)
                    for i, x in zip(at, got):
                        out[i] = x.tolist()
                columns = [batch.column(0), batch.column(1), pa.array(seen, kind), pa.array(out, kind), pa.array(np.arange(batch.num_rows))]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "v", "seen", "tiles", "deal"])

    chosen = queries.select("query", "v", "seen", "least") if later else queries.select("query", "v")
    return chosen.mapInArrow(run, "query long, v array<double>, seen array<int>, tiles array<int>, deal long")


def _meet(rows: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(query, row, cosine): the ``k`` best rows of each query in each tile it visits. A tile that many queries visit is copied for each
    MAX_QUERIES of them; rows of a tile that none visits do not move."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {length: Best(q, v, k) for length, q, v in _by_length(left["query"].combine_chunks(), left["v"].combine_chunks())} if left.num_rows else {}
        if right.num_rows:
            for length, keys, v in _by_length(right["row"].combine_chunks(), right["v"].combine_chunks()):
                if length in found:
                    found[length].see(keys, v)
        return pa.Table.from_batches([b.batch() for b in found.values()], pa.schema([("query", pa.int64()), ("row", pa.int64()), ("cosine", pa.float64())]))

    single = visits.select("query", "v", "deal", F.explode("tiles").alias("tile"))
    counts = single.groupBy("tile").agg(F.ceil(F.count("*") / MAX_QUERIES).cast("int").alias("copies"))
    counts = saved(counts)  # a row for each tile, as the driver has them
    left = single.join(F.broadcast(counts), "tile").select("query", "v", "tile", F.pmod(F.xxhash64("query", "deal"), F.col("copies")).cast("int").alias("part"))
    right = rows.join(F.broadcast(counts), "tile").select("row", "v", "tile", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
    return left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(meet, _FOUND)


def _least_keys(rows: DataFrame, k: int) -> DataFrame:
    """(length, row): the ``k`` least keys of each length of vector, cut in the tasks first; what any zero query finds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths, keys = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for n in np.unique(lengths):
                kept[n] = np.sort(np.concatenate([kept.get(n, keys[:0]), keys[lengths == n]]))[:k]
        for n, keys in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, dtype=np.int32)), pa.array(keys)], names=["length", "row"])

    few = rows.select(F.size("v").alias("length"), "row").mapInArrow(cut, "length int, row long")
    rank = F.row_number().over(Window.partitionBy("length").orderBy("row"))
    return few.withColumn("rank", rank).where(F.col("rank") <= k).select("length", "row")


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, row, cosine), as :func:`nearest`, for (row, v) and (query, v) of any number.

    Rows are put into tiles about pivots. Each query first meets the closest tiles that hold ``k`` rows; the ``k``-th cosine found there is
    a bound, and of the other tiles it meets those only that may hold a row as good, by triangle bounds on angles. Vectors without structure
    meet most tiles. What the driver holds are the pivots and four numbers of a tile. Zero queries, which have cosine 0
    with all, find the least keys and meet no tile."""
    cells, each = _cells_of(rows, rows.count())
    tiled, tiles = _tiled(rows, cells, each)
    zero = ~F.exists("v", lambda x: x != 0)
    seen = saved(_visits(queries.where(~zero), tiles, k))
    found = saved(_meet(tiled, seen, k))
    least = found.groupBy("query").agg(F.sort_array(F.collect_list("cosine"), False).alias("c"))  # at most k rows from each of k tiles
    least = least.select("query", F.get("c", F.lit(k - 1)).alias("least"))
    bounded = seen.select("query", "v", F.col("tiles").alias("seen")).join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("nan"))))
    more = _meet(tiled, saved(_visits(bounded, tiles, k)), k)
    blank = queries.where(zero).select("query", F.size("v").alias("length")).join(_least_keys(rows, k), "length").select("query", "row", F.lit(0.0).alias("cosine"))
    return found.unionByName(more).unionByName(blank)


def assign_problem(vectors: DataFrame, centers: DataFrame, key: str = "vec_id") -> DataFrame:
    """(``key``, problem_id, cosine): each reaction's nearest problem, the lesser id among equals.

    Up to MAX_QUERIES centers, which are counted, go to the tasks, which return one row per vector; more are tiles of a :func:`search` that vectors
    visit. Vectors that :func:`nearest` passes over have no problem and no row."""
    rows, known = _vectors(vectors, key, "row"), _vectors(centers, "problem_id", "query")
    n = known.count()
    if n > MAX_QUERIES:
        swapped = search(known.withColumnRenamed("query", "row"), rows.withColumnRenamed("row", "query"), 1)
        out = swapped.select(F.col("query").alias("row"), F.col("row").alias("query"), "cosine")
    else:
        table = known.orderBy("query").toArrow().combine_chunks()
        ids, lists = (c.combine_chunks() for c in table.columns) if n else (pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64())))
        sent = rows.sparkSession.sparkContext.broadcast(list(_by_length(ids, lists)))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_length = {length: (ids, v) for length, ids, v in sent.value}
            for batch in batches:
                for length, keys, v in _by_length(batch.column(0), batch.column(1)):
                    ids, c = of_length.get(length, (None, None))
                    if ids is None:
                        continue
                    step = max(1, MAX_CELLS // len(ids))
                    for a in range(0, len(keys), step):
                        cosine = v[a : a + step] @ c.T
                        first = np.round(cosine, 6).argmax(axis=1)  # of equal ones the first, and ids rise
                        best = cosine[np.arange(len(first)), first]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + step]), pa.array(ids[first]), pa.array(best)], names=["row", "query", "cosine"])

        out = rows.mapInArrow(assign, "row long, query long, cosine double")
    best = out.groupBy("row").agg(F.max(F.struct(F.round("cosine", 6).alias("cosine"), (-F.col("query")).alias("minus"))).alias("best"))
    return best.select(F.col("row").alias(key), (-F.col("best.minus")).cast("int").alias("problem_id"), F.col("best.cosine").alias("cosine"))


def phrase_candidates(docs: DataFrame, least: int = 5, ratio: float = 10.83, text: str = "text") -> DataFrame:
    """(first, second, n, llr): pairs of adjacent words that stand together more often than their own frequencies say, by Dunning's log-likelihood ratio.

    At least ``least`` times, and with a ratio of ``ratio`` (one in a thousand by chance). Pairs are counted before they are shuffled; what words
    count on their own, as the first or the second of a pair, follows from the counts of pairs, so that texts are read once. Pairs that are too rare go
    before they meet those counts. Null texts and texts of one word have no pair.
    """
    words = docs.select(F.explode(F.array(tokens(F.col(text)))).alias("w"))  # bound, else texts are split for each pair
    n = F.greatest(F.size("w") - 1, F.lit(0))
    both = words.select(F.explode(F.arrays_zip(F.slice("w", 1, n).alias("first"), F.slice("w", 2, n).alias("second"))).alias("p")).select("p.first", "p.second")
    pairs = saved(both.groupBy("first", "second").agg(F.count("*").alias("n")))
    kept = pairs.where(F.col("n") >= least)
    heads = pairs.groupBy("first").agg(F.sum("n").alias("n_first"))
    tails = pairs.groupBy("second").agg(F.sum("n").alias("n_second"))
    total = pairs.agg(F.sum("n").cast("double").alias("total"))
    rows = kept.join(heads, "first").join(tails, "second").join(F.broadcast(total))  # one row
    a, b, c = F.col("n"), F.col("n_first") - F.col("n"), F.col("n_second") - F.col("n")
    cells = [(a, "n_first", "n_second"), (b, "n_first", None), (c, None, "n_second"), (F.col("total") - a - b - c, None, None)]

    def share(k: Column, first: str | None, second: str | None) -> Column:
        r = F.col(first) if first else F.col("total") - F.col("n_first")
        s = F.col(second) if second else F.col("total") - F.col("n_second")
        return F.when(k > 0, k * F.ln(k * F.col("total") / (r.cast("double") * s))).otherwise(0.0)

    llr = 2 * (share(*cells[0]) + share(*cells[1]) + share(*cells[2]) + share(*cells[3]))
    more = F.col("n") * F.col("total") > F.col("n_first").cast("double") * F.col("n_second")
    return rows.where(more).select("first", "second", "n", F.round(llr, 4).alias("llr")).where(F.col("llr") >= ratio)
