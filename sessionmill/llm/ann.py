"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample and every vector is filed under its leaf in
each tree. A query goes through all trees with one priority queue: the leaf whose
worst margin is best comes next, whichever tree it is in. How many leaves a query
visits is measured: as many as reach most of the true neighbours of some probes,
which are compared with all vectors. So structured vectors are searched in few
leaves, and vectors without structure in many. The queue is worked off in rounds, each of several times the leaves of the
one before: the best that a query has found is the least that a later leaf has to
beat, so few candidates leave the leaves however many are visited. Candidates are
ranked by their exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.session import prepare, stored


#: Queries that are compared with a block's vectors in one matrix.
QUERIES_AT_ONCE = 512


class Forest:
    """Trees as arrays: node i of a tree has children 2i+1 and 2i+2 in a full tree of ``depth`` levels."""

    def __init__(self, depth: int, normals: np.ndarray, offsets: np.ndarray):
        self.depth, self.trees, self.normals, self.offsets = depth, len(normals), normals, offsets

    @staticmethod
    def fitted(sample: np.ndarray, trees: int, depth: int, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
        """The parts of a forest, as plain arrays that any executor can receive."""
        rng = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        normals = np.zeros((trees, inner, sample.shape[1]), np.float32)
        offsets = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(inner):
                own = members.pop(node)
                # the plane between two random members, moved to the median of all
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    normal = a - b
                else:
                    normal = rng.standard_normal(sample.shape[1])
                norm = np.linalg.norm(normal)
                normal = normal / norm if norm > 0 else rng.standard_normal(sample.shape[1]).astype(np.float32)
                side = sample[own] @ normal
                offset = np.median(side) if len(own) else 0.0
                normals[t, node], offsets[t, node] = normal, offset
                members[2 * node + 1], members[2 * node + 2] = own[side <= offset], own[side > offset]
        return depth, normals, offsets

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (0 to 2**depth - 1) of each vector in each tree."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.offsets[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, x: np.ndarray, visits: int) -> list[list[tuple[int, int]]]:
        """For each query, the ``visits`` (tree, leaf) that one priority queue over all trees reaches first."""
        inner = (1 << self.depth) - 1
        out = []
        for v in x:
            margins = self.normals @ v - self.offsets
            queue, found = [(0.0, t, 0) for t in range(self.trees)], []
            while queue and len(found) < visits:
                worst, t, node = heapq.heappop(queue)
                if node >= inner:
                    found.append((t, node - inner))
                    continue
                margin = float(margins[t, node])
                heapq.heappush(queue, (max(worst, margin), t, 2 * node + 1))
                heapq.heappush(queue, (max(worst, -margin), t, 2 * node + 2))
            out.append(found)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, worked out in extended precision, so that equal cosines are equal numbers."""
    a, b = (unit(x.astype(np.longdouble)) for x in (a, b))
    return np.clip((a * b).sum(axis=1), -1, 1).astype(np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _leaf_sizes(forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Forest(*forest.value)
        for batch in batches:
            if batch.num_rows:
                place = built.leaves(unit(_matrix(batch["embedding"])).astype(np.float32)) + (np.arange(built.trees, dtype=np.int32) << built.depth)
                place, n = np.unique(place, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(n)], names=["place", "n"])

    return run


def _filed(forest, blocks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector under its leaf in each tree; a leaf's vectors are dealt to as many blocks as it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, parts = Forest(*forest.value), blocks.value
        trees = built.trees
        for batch in batches:
            if batch.num_rows:
                leaves = built.leaves(unit(_matrix(batch["embedding"])).astype(np.float32))
                rows = np.repeat(np.arange(len(leaves)), trees)
                block = batch["key"].to_numpy()[rows] % parts[np.tile(np.arange(trees), len(leaves)), leaves.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(leaves))), pa.array(leaves.ravel()), pa.array(block.astype(np.int32)), *[batch[n].take(pa.array(rows)) for n in ("key", "ids", "embedding")]], names=["tree", "leaf", "block", "key", "ids", "embedding"])

    return run


def _asked(forest, begin: int, end: int, blocks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query under the leaves that it reaches from number ``begin`` up to ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, parts = Forest(*forest.value), blocks.value
        for batch in batches:
            if batch.num_rows:
                found = built.search(unit(_matrix(batch["embedding"])).astype(np.float32), end)
                rows = [(t, leaf, b, i) for i, own in enumerate(found) for t, leaf in own[begin:] for b in range(parts[t, leaf])]
                columns = [np.array(c, np.int32) for c in zip(*rows, strict=True)]
                take = pa.array(columns[3])
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns[:3]], *[batch[n].take(take) for n in ("key", "least", "embedding")]], names=["tree", "leaf", "block", "query", "least", "embedding"])

    return run


def best_pairs(a: np.ndarray, b: np.ndarray, least_id: np.ndarray, most: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, exact cosine) of the ``most`` best rows of b for each row of a, of those that reach its ``least`` cosine; ties go to the smaller id."""
    near = unit(a) @ unit(b).T
    k = min(most, near.shape[1])
    worst = -np.partition(-near, k - 1, axis=1)[:, k - 1]
    if least is not None:
        worst = np.maximum(worst, least)
    q, c = np.nonzero(near >= worst[:, None] - 1e-9)
    if not len(q):
        return q, c, np.zeros(0)
    exact = np.concatenate([cosines(a[q[i : i + 100_000]], b[c[i : i + 100_000]]) for i in range(0, len(q), 100_000)])
    if least is not None:
        reach = exact >= least[q]
        q, c, exact = q[reach], c[reach], exact[reach]
    order = np.lexsort((least_id[c], -exact, q))
    q, c, exact = q[order], c[order], exact[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], c[best], exact[best]


def _ranked(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best ``most`` candidates of a leaf's block for each query that visits it, QUERIES_AT_ONCE of them at a time."""

    def run(filed: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if filed.num_rows:
            least_id, held = pc.list_element(filed["ids"].combine_chunks(), 0).to_numpy(), _matrix(filed["embedding"])
            for first in range(0, asked.num_rows, QUERIES_AT_ONCE):
                part = asked.slice(first, QUERIES_AT_ONCE)
                q, c, exact = best_pairs(_matrix(part["embedding"]), held, least_id, most, part["least"].to_numpy())
                found.append((q + first, c, exact))
        q, c, exact = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query": asked["query"].take(pa.array(q)), "key": filed["key"].take(pa.array(c)), "ids": filed["ids"].take(pa.array(c)), "score": pa.array(exact)})

    return run


def _compared(probes, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``most`` of each batch for every probe: (probe, score, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, c, exact = best_pairs(probes.value, _matrix(batch["embedding"]), batch["key"].to_numpy(), most)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(exact), batch["embedding"].take(pa.array(c))], names=["probe", "score", "embedding"])

    return run


def needed_visits(forest: Forest, probes: np.ndarray, of: np.ndarray, found: np.ndarray, recall: float) -> int:
    """How many leaves each of ``probes`` has to visit so that ``recall`` of the vectors ``found`` (of probe number ``of``) are reached."""
    leaves = forest.leaves(unit(found).astype(np.float32))
    reached = np.zeros(len(found), np.int64)
    for p, order in enumerate(forest.search(unit(probes).astype(np.float32), forest.trees << forest.depth)):
        place = np.zeros((forest.trees, 1 << forest.depth), np.int64)
        t, leaf = np.array(order).T
        place[t, leaf] = np.arange(1, len(order) + 1)
        own = np.flatnonzero(of == p)
        reached[own] = place[np.arange(forest.trees), leaves[own]].min(axis=1)
    return int(np.quantile(reached, recall, method="higher")) if len(reached) else forest.trees


def rounds(first: int, visits: int, times: int) -> list[int]:
    """Where each round of leaves ends: about ``times`` as many every time, evenly, from ``first`` to ``visits``."""
    steps = max(0, round(np.log(visits / first) / np.log(times))) if visits > first else 0
    return [*[int(first * (visits / first) ** (i / max(1, steps))) for i in range(steps)], visits]


def neighbours(vectors: DataFrame, query_every: int = 50, k: int = 5, trees: int = 16, leaf_rows: int = 64, recall: float = 0.96, most_sample: int = 200_000, most_probes: int = 64, block_rows: int = 2_000, seed: int = 3) -> DataFrame:
    """The ``k`` nearest vectors, by cosine, of each row whose vec_id is divisible by ``query_every``.

    ``vectors`` needs vec_id (long) and embedding (array of numbers); other columns
    are ignored. Equal vectors are filed once, with the k + 1 smallest of their ids,
    so that any number of copies takes one place and no task holds them all. The
    trees are fitted on the ``most_sample`` distinct vectors of least hash, down to
    leaves of about ``leaf_rows`` of these, and so grow with the table up to that
    bound. ``most_probes`` vectors are compared with all others; a query visits as
    many leaves as reach ``recall`` of the probes' true neighbours. Each leaf of
    more than ``block_rows`` vectors is compared in blocks of that size, so tight
    clusters and tables far larger than the sample keep tasks bounded, and a block
    gives at most k + 1 candidates a query, none that is farther than k + 1 classes of
    earlier rounds.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A
    row's own vec_id is no candidate. Vectors that are null, empty, zero, of another
    length than most, or that hold null or non-finite components take no part, nor
    do rows without vec_id; of rows with an equal vec_id and vector one counts. A
    single usable vector, and an empty table, give an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda e: F.coalesce((F.abs(e) < float("inf")) & ~F.isnan(e), F.lit(False))) & F.exists("embedding", lambda e: e != 0)
    x = x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    sizes = x.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal vectors: first the smallest ids of each of many parts, then of all
    x = x.where(F.size("embedding") == sizes.n).withColumn("key", F.xxhash64("embedding"))
    parts = x.groupBy("key", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    distinct = parts.groupBy("key", "embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    distinct = stored(distinct, "vectors")
    sample = _matrix(distinct.orderBy("key").limit(most_sample).select("embedding").toArrow()["embedding"])
    depth = max(0, int(np.log2(max(1, len(sample) / leaf_rows))))
    parts = Forest.fitted(unit(sample).astype(np.float32), trees, depth, seed)
    forest, probes = spark.sparkContext.broadcast(parts), sample[:: max(1, len(sample) // most_probes)][:most_probes]
    visits = trees
    if depth:
        # the best of a probe is itself
        compared = distinct.select("key", "embedding").mapInArrow(_compared(spark.sparkContext.broadcast(probes), k + 1), "probe long, score double, embedding array<double>")
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "embedding"))
        truth = compared.withColumn("place", place).where(F.col("place").between(2, k + 1)).select("probe", "embedding").toArrow()
        visits = needed_visits(Forest(*parts), probes, truth["probe"].to_numpy(), _matrix(truth["embedding"]), recall)
    sizes = distinct.select("embedding").mapInArrow(_leaf_sizes(forest), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    blocks = np.ones((trees, 1 << depth), np.int64)
    blocks.ravel()[sizes["place"].to_numpy()] = -(-sizes["n"].to_numpy() // block_rows)
    blocks = spark.sparkContext.broadcast(blocks)

    asking = x.where(F.col("vec_id") % query_every == 0).select("key", "embedding", "vec_id").distinct()
    filed = distinct.mapInArrow(_filed(forest, blocks), "tree int, leaf int, block int, key long, ids array<long>, embedding array<double>")
    questions = asking.select("key", "embedding").distinct()
    # the best classes of equal vectors first, then the best of their ids
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    classes, begin = None, 0
    for end in rounds(trees, visits, 4):
        asked = questions.withColumn("least", F.lit(-2.0))
        if classes is not None:
            # a query that has not found k + 1 classes yet takes any
            least = classes.where(F.col("at") == k + 1).select(F.col("query").alias("key"), F.col("score").alias("least"))
            asked = questions.join(least, "key", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        asked = asked.mapInArrow(_asked(forest, begin, end, blocks), "tree int, leaf int, block int, query long, least double, embedding array<double>")
        near = filed.groupBy("tree", "leaf", "block").cogroup(asked.groupBy("tree", "leaf", "block")).applyInArrow(_ranked(k + 1), "query long, key long, ids array<long>, score double")
        if classes is not None:
            near = near.unionByName(classes.drop("at"))
        classes = stored(near.dropDuplicates(["query", "key"]).withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k + 1), "nearest")
        begin = end
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    scored = classes.select("query", F.explode("ids").alias("vec_id"), "score").withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")
    told = asking.select("key", F.col("vec_id").alias("query_id")).join(scored, F.col("key") == F.col("query")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return told.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
