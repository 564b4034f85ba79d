r"""Nearest neighbours by inner product from balanced posting lists.

Vectors get one component more, ``sqrt(longest squared norm - own squared norm)`` (0 for a query), so that
the largest inner product is the smallest distance.  A bounded sample is split by two-means until
clusters are small; their centroids and a graph of each centroid's nearest ones, both of bounded
size, are broadcast.  A walk over the graph finds the centroids near a vector, for a whole batch at
a time.  Every vector stands in the posting list of its nearest centroid and, if it lies near a
boundary, in those of others that are hardly farther.  A query reads the lists whose centroids are at
most a ratio farther than its nearest one.

The ratio is not guessed: a bounded sample of queries is compared with all vectors, and the ratio is
the one that leads to a target share of the true neighbours.  Where none within reach of the walk does, a
query reads all lists.

Equal vectors are indexed as one row with all their ids beside it (``members``).  As ties go to the
smaller id, a query needs only the first ``k + 1`` ids of equal vectors, its own id among them.
The nearest lists are read first; the others pass on only vectors that reach the ``k + 1`` best found
there.  Lists and their queries are cut into blocks of bounded size, and every block of a list meets every block of its queries in
a task of its own, so that a large list or a frequent query is spread.

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component take
no part, nor do rows without an id, which no result could name; vectors of unequal length are
compared as if the shorter one ended in zeros; equal rows count once; a row's own id is never its
neighbour, so that an id with several vectors may get fewer than ``k``; with fewer than ``k`` candidates all are
returned; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.llm.common import small, stored

K = 20
# Rows that the centroids are fitted on, and queries that the ratio is fitted on, at most (on average).
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 200
# Centroids: one for so many vectors, at most so many.
LIST_ROWS = 100
MAX_LISTS = 2_000
# Neighbours of a centroid in the graph, and centroids that a walk keeps for a vector and, at least, for a query.
DEGREE = 24
VECTOR_BEAM = 24
BEAM = 64
# Lists that tell a query how large a product has to be to count.
FIRST_LISTS = 8
# Lists that hold a vector, and how much farther than the nearest one they may be.
REPLICAS = 4
REPLICA_RATIO = 1.05
TARGET_RECALL = 0.97
# Vectors of a list, and queries of a list, that meet in one task.
BLOCK_ROWS = 4_096

DOUBLES = "array<double>"


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, vec)``: rows with an id and a finite vector that is not zero."""
    vec = F.col("embedding").cast(DOUBLES)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    )


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``(key, vec, ids)``: each vector once, with its ``k + 1`` smallest ids."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    # The rank is limited before rows are shuffled, so equal vectors do not meet in one task.
    ranked = rows.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k + 1)
    grouped = ranked.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return stored(grouped.select(F.monotonically_increasing_id().alias("key"), "vec", "ids"), "ann-vectors")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column, ended by zeros up to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    found = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    found[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return found


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all of them equally long; ``longest`` is the largest squared norm."""
    rest = np.sqrt(np.maximum(0.0, longest - (vectors * vectors).sum(1)))
    return np.hstack([vectors, rest[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def balanced_centroids(sample: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """Centroids of clusters of nearly equal size: the largest cluster is cut in half along the line
    between its two means, until there are enough."""
    random = np.random.default_rng(seed)
    waiting, done = [np.arange(len(sample))], []
    limit = max(1.0, len(sample) / max(1, count))
    while waiting:
        rows = waiting.pop()
        if len(rows) <= 1.5 * limit or len(rows) < 2:
            done.append(sample[rows].mean(0))
            continue
        own = sample[rows]
        ends = own[random.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = own @ (ends[1] - ends[0])
            order = np.argsort(side, kind="stable")
            half = len(order) // 2
            ends = np.stack([own[order[:half]].mean(0), own[order[half:]].mean(0)])
        waiting += [rows[order[:half]], rows[order[half:]]]
    return np.array(done)


@dataclass
class Centroids:
    """Centroids, the graph between them, and what a walk needs to know."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    longest: float
    width: int

    @staticmethod
    def fitted(sample: np.ndarray, count: int, longest: float) -> Centroids:
        points = balanced_centroids(lifted(sample, longest), count)
        near = np.argsort(distances(points, points), axis=1, kind="stable")
        degree = min(DEGREE, len(points))
        # Nearest ones keep a walk close; a few spread ones lead it away from where it began.
        spread = np.random.default_rng(2).integers(0, len(points), (len(points), 4))
        graph = np.hstack([near[:, 1:degree + 1] if degree > 1 else near[:, :1], spread])
        entries = np.unique(np.linspace(0, len(points) - 1, min(16, len(points))).astype(np.int64))
        return Centroids(points, graph, entries, longest, sample.shape[1])

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the centroids near each vector, nearest first; what was not found is -1."""
        if 4 * beam >= len(self.points):
            # A walk that keeps so many would see nearly all.
            found = distances(vectors, self.points)
            order = np.argsort(found, axis=1, kind="stable")
            return order, np.take_along_axis(found, order, 1)
        squared = (self.points * self.points).sum(1)
        own = (vectors * vectors).sum(1)

        def measured(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            inner = np.einsum("rnd,rd->rn", self.points[numbers], vectors[rows])
            return np.maximum(own[rows][:, None] + squared[numbers] - 2 * inner, 0.0)

        every = np.arange(len(vectors))
        held = np.full((len(vectors), beam), -1, np.int64)
        far = np.full((len(vectors), beam), np.inf)
        seen = np.ones((len(vectors), beam), bool)
        first = np.tile(self.entries, (len(vectors), 1))[:, :beam]
        held[:, :first.shape[1]], far[:, :first.shape[1]], seen[:, :first.shape[1]] = first, measured(every, first), False
        rows = every
        while len(rows):
            # The nearest centroids not yet walked from.
            step = 4
            open_ = np.where(seen[rows], np.inf, far[rows])
            chosen = np.argsort(open_, axis=1, kind="stable")[:, :step]
            live = np.isfinite(np.take_along_axis(open_, chosen, 1))
            going = live.any(1)
            rows, chosen, live = rows[going], chosen[going], live[going]
            if not len(rows):
                break
            at = np.where(live, held[rows[:, None], chosen], held[rows, chosen[:, 0]][:, None])
            marks = seen[rows]
            np.put_along_axis(marks, chosen, True, 1)
            more = self.graph[at].reshape(len(rows), -1)
            numbers = np.hstack([held[rows], more])
            away = np.hstack([far[rows], measured(rows, more)])
            known = np.hstack([marks, np.zeros(more.shape, bool)])
            # Equal numbers next to each other, those held before first; the later ones go.
            order = np.argsort(numbers, axis=1, kind="stable")
            numbers, away, known = (np.take_along_axis(x, order, 1) for x in (numbers, away, known))
            away[:, 1:][(numbers[:, 1:] == numbers[:, :-1]) | (numbers[:, 1:] < 0)] = np.inf
            order = np.argsort(away, axis=1, kind="stable")[:, :beam]
            numbers, away, known = (np.take_along_axis(x, order, 1) for x in (numbers, away, known))
            gone = ~np.isfinite(away)
            numbers[gone], known[gone] = -1, True
            held[rows], far[rows], seen[rows] = numbers, away, known
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(held, order, 1), np.sqrt(np.take_along_axis(far, order, 1))


def within(near: tuple[np.ndarray, np.ndarray], ratio: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, list)`` of centroids at most ``ratio`` times as far as the nearest one, the nearest in place 0."""
    numbers, away = near
    taken = (away <= away[:, :1] * ratio + 1e-12) & (numbers >= 0)
    taken[:, 0] = numbers[:, 0] >= 0
    if most is not None:
        taken[:, most:] = False
    rows, places = np.nonzero(taken)
    return rows, places, numbers[rows, places]


def _assign(centroids, query: bool, beam: int, ratio: float, most: int | None):
    """Rows ``(key, vec)`` as ``(list, place, key, vec)`` for each list they belong to or, as queries, read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = centroids.value
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                vectors = matrix(part["vec"], held.width)
                points = np.hstack([vectors, np.zeros((len(vectors), 1))]) if query else lifted(vectors, held.longest)
                rows, places, lists = within(held.search(points, beam), ratio, most)
                picked = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int64()), pa.array(places, pa.int32()), picked["key"], picked["vec"]],
                    names=["list", "place", "key", "vec"],
                )

    return run


def products(queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Inner products of chosen pairs, added component by component in order."""
    found = np.zeros(len(rows))
    for first in range(0, len(rows), 65_536):
        part = slice(first, first + 65_536)
        found[part] = np.cumsum(queries[rows[part]] * vectors[places[part]], axis=1)[:, -1]
    return found


def best_of(queries: np.ndarray, vectors: np.ndarray, smallest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, vector row, score)`` of the ``k`` largest products of each query, ties to the smaller id."""
    rows_, places_, scores_ = [], [], []
    for first in range(0, len(queries), 512):
        own = queries[first:first + 512]
        rough = own @ vectors.T
        count = min(k, len(vectors))
        least = np.partition(rough, len(vectors) - count, axis=1)[:, len(vectors) - count]
        # Products are added in another order here: all that could be among the best are added up again.
        slack = 1e-12 * (np.abs(own) @ np.abs(vectors).max(0))
        rows, places = np.nonzero(rough >= (least - slack)[:, None])
        scores = products(own, vectors, rows, places)
        order = np.lexsort((smallest[places], -scores, rows))
        rows, places, scores = rows[order], places[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < count
        rows_.append(rows[kept] + first), places_.append(places[kept]), scores_.append(scores[kept])
    return np.concatenate(rows_), np.concatenate(places_), np.concatenate(scores_)


def _meet(width: int, k: int):
    """The best vectors of a block for each query of a block, of those with at least the query's ``floor``."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not len(queries) or not len(block):
            rows = places = np.zeros(0, np.int64)
            scores = np.zeros(0)
        else:
            rows, places, scores = best_of(
                matrix(queries["vec"], width), matrix(block["vec"], width), block["least"].to_numpy(), k
            )
            enough = scores >= queries["floor"].to_numpy()[rows]
            rows, places, scores = rows[enough], places[enough], scores[enough]
        return pa.table({
            "query": queries["key"].take(pa.array(rows)), "key": block["key"].take(pa.array(places)),
            "least": block["least"].take(pa.array(places)), "score": pa.array(scores),
        })

    return run


def _all_pairs(queries, width: int, k: int):
    """The best vectors of each batch for a few queries that every task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, points = queries.value
        for batch in batches:
            if len(batch):
                smallest = batch["least"].to_numpy()
                rows, places, scores = best_of(points, matrix(batch["vec"], width), smallest, k)
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array(keys[rows], pa.int64()), "key": batch["key"].take(pa.array(places)),
                    "least": pa.array(smallest[places]), "score": pa.array(scores),
                })

    return run


ASSIGNED = f"list bigint, place int, key bigint, vec {DOUBLES}"
FOUND = "query bigint, key bigint, least bigint, score double"


def best_found(found: DataFrame, k: int) -> DataFrame:
    """``(query, key, least, score)``: of what all blocks found, the ``k`` best of each query."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "least", "key")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


@dataclass
class Index:
    """Posting lists over distinct vectors: ``members`` has every vector with its ids, ``postings`` the lists."""

    spark: SparkSession
    vectors: DataFrame
    members: DataFrame
    postings: DataFrame | None
    centroids: object
    width: int
    k: int
    ratio: float
    beam: int
    recall: float


def _bounded(frame: DataFrame, total: int, rows: int, salt: str) -> DataFrame:
    """On average ``rows`` rows, chosen by a hash of their ids."""
    share = min(1.0, rows / max(1, total))
    return frame.filter(F.pmod(F.xxhash64(F.lit(salt), F.element_at("ids", 1)), F.lit(1 << 30)) < int(share * (1 << 30)))


def build_index(embeddings: DataFrame, k: int = K, target: float = TARGET_RECALL) -> Index:
    """Stores the index of all rows and fits the ratio that finds ``target`` of the sampled queries' neighbours."""
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings), "ann-rows")
    vectors = distinct_vectors(rows, k)
    squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    total, width, longest = vectors.agg(F.count("*"), F.max(F.size("vec")), F.max(squares)).first()
    if not total:
        return Index(spark, vectors, rows, None, None, 0, k, 1.0, 1, 1.0)
    sample = matrix(_bounded(vectors, total, SAMPLE_ROWS, "fit").select("vec").toArrow()["vec"], width)
    if not len(sample):
        sample = matrix(vectors.limit(100).select("vec").toArrow()["vec"], width)
    lists = max(1, min(MAX_LISTS, total // LIST_ROWS))
    fitted = Centroids.fitted(sample, lists, longest * (1 + 1e-9))
    centroids = spark.sparkContext.broadcast(fitted)
    assign = _assign(centroids, False, VECTOR_BEAM, REPLICA_RATIO, REPLICAS)
    placed = vectors.select("key", "vec").mapInArrow(assign, ASSIGNED).drop("place")
    smallest = vectors.select("key", F.element_at("ids", 1).alias("least"))
    postings = stored(placed.join(smallest, "key").repartition("list", "key"), "ann-postings")
    ratio, beam, recall = _fitted_ratio(spark, vectors, postings, fitted, total, k, target)
    return Index(spark, vectors, rows, postings, centroids, width, k, ratio, beam, recall)


def _fitted_ratio(spark, vectors: DataFrame, postings: DataFrame, fitted: Centroids, total: int, k: int, target: float) -> tuple[float, int, float]:
    """The smallest ratio, and the walk's beam, with which ``target`` of sampled queries' true neighbours are found."""
    some = _bounded(vectors, total, SAMPLE_QUERIES, "queries").select("key", "vec").toArrow()
    if not len(some):
        some = vectors.limit(20).select("key", "vec").toArrow()
    keys, points = some["key"].to_numpy(), matrix(some["vec"], fitted.width)
    shared = spark.sparkContext.broadcast((keys, points))
    scanned = vectors.select("key", "vec", F.element_at("ids", 1).alias("least"))
    truth = best_found(scanned.mapInArrow(_all_pairs(shared, fitted.width, k + 1), FOUND), k + 1)
    lists = truth.join(postings.select("key", "list"), "key").select("query", "key", "list").toArrow()
    # Bounded: so many queries, k + 1 neighbours of each, in so many lists.
    place = {key: number for number, key in enumerate(keys.tolist())}
    lifted_queries = np.hstack([points, np.zeros((len(points), 1))])
    numbers, away = fitted.search(lifted_queries, len(fitted.points))
    rank = np.empty_like(numbers)
    np.put_along_axis(rank, numbers, np.arange(numbers.shape[1])[None, :].repeat(len(numbers), 0), 1)
    asked = np.array([place[query] for query in lists["query"].to_pylist()])
    held = lists["list"].to_numpy()
    ranks = rank[asked, held]
    farther = away[asked, ranks] / np.maximum(away[asked, 0], 1e-12)
    pairs = {}
    for query, key, one, far in zip(asked.tolist(), lists["key"].to_pylist(), ranks.tolist(), farther.tolist()):
        if (query, key) not in pairs or far < pairs[query, key][0]:
            pairs[query, key] = (far, one)
    needed = np.array(sorted(pairs.values()))
    ratio = float(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1), 0]) * (1 + 1e-9)
    # The walk keeps as many centroids as the widest of these queries reads.
    reads = int((away <= away[:, :1] * ratio + 1e-12).sum(1).max())
    beam = min(len(fitted.points), max(BEAM, int(1.25 * reads)))
    return ratio, beam, float((needed[:, 0] <= ratio).mean())


def _met(index: Index, asked: DataFrame) -> DataFrame:
    """What the lists hold for the queries that read them: every block of a list with every block of its queries."""
    left, right = (
        frame.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
        for frame, name in ((asked, "query_blocks"), (index.postings, "blocks"))
    )
    sizes = small(left.join(right, "list"))

    def blocks(frame: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        return frame.join(sizes, "list").withColumn(names[0], F.pmod(F.xxhash64("key"), F.col(own))).withColumn(
            names[1], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other).cast("bigint") - 1))
        ).drop(own, other)

    ask = blocks(asked, "query_blocks", "blocks", ("a", "b")).groupBy("list", "a", "b")
    hold = blocks(index.postings, "blocks", "query_blocks", ("b", "a")).groupBy("list", "a", "b")
    return ask.cogroup(hold).applyInArrow(_meet(index.width, index.k + 1), FOUND)


def search(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row ``(vec_id, vec)`` of usable vectors."""
    k, spark = index.k, index.spark
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if index.postings is None:
        return spark.createDataFrame([], schema)
    # Equal query vectors are searched for once.
    asking = stored(
        queries.select("vec").distinct().select(F.monotonically_increasing_id().alias("key"), "vec"), "ann-asking"
    )
    assign = _assign(index.centroids, True, index.beam, index.ratio, None)
    # Few rows, much work on each: they are dealt out over all cores.
    parts = max(spark.sparkContext.defaultParallelism, asking.count() // 10_000)
    asked = stored(asking.repartition(parts, "key").mapInArrow(assign, ASSIGNED), "ann-asked")
    nearer = asked.filter(F.col("place") < FIRST_LISTS).withColumn("floor", F.lit(float("-inf")))
    first = stored(best_found(_met(index, nearer), k + 1), "ann-first")
    # What the nearest lists hold already bounds what can still be among the best.
    floors = first.groupBy(F.col("query").alias("key")).agg(
        F.when(F.count("*") == k + 1, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor")
    )
    farther = asked.filter(F.col("place") >= FIRST_LISTS).join(floors, "key", "left").fillna(float("-inf"), ["floor"])
    found = _met(index, farther).unionByName(first)
    best = best_found(found, k + 1).join(index.vectors.select("key", "ids"), "key")
    answers = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("answers"))
    answered = asking.withColumnRenamed("key", "query").join(answers, "query").select("vec", "answers")
    rows = queries.select(F.col("vec_id").alias("query_id"), "vec").distinct().join(answered, "vec")
    each = rows.select("query_id", F.flatten(F.transform("answers", lambda a: F.transform(
        a["ids"], lambda i: F.struct((-a["score"]).alias("less"), i.alias("vec_id"))
    ))).alias("near"))
    others = F.array_distinct(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")))
    return each.select("query_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("place", "n")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.less")).alias("score")
    )


def nearest(embeddings: DataFrame, every: int, k: int = K) -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``, among all others."""
    index = build_index(embeddings, k)
    return search(index, index.members.filter(F.col("vec_id") % every == 0))
