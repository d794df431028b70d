"""Hard negatives by inner product, found with R-trees that are packed sort-tile-recursive.

All vectors are cut into tiles as one sort-tile-recursive packing would cut them: by
the quantiles of a coordinate, each slab by those of the next. A tile's box bounds
every coordinate, and so the inner product of any anchor with what lies in it.
Anchors ask tiles best bound first, in rounds: tiles that lie outside an anchor's
score window, or strictly below the k-th best that it has found, are never asked.
Within a tile's rows an R-tree of the same packing is worked off with one best-first
queue per anchor under the same two rules. What is returned is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionmill.llm.session import discard, prepare, stored

#: Components beyond this are taken as this, so that every score has at most 38 digits.
MOST = 1 << 50
LEAVES_AT_ONCE = 4


def slabs(pages: int, left: int) -> int:
    """Into how many slabs ``pages`` are cut along a coordinate if ``left`` coordinates are left, this one included."""
    return max(2, math.ceil(pages ** (1 / left) - 1e-9))


def packed_runs(x: np.ndarray, dims: list[int], page: int, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` of x in runs of at most ``page``, sorted and tiled along one of ``dims`` after the other."""
    pages = -(-len(rows) // page)
    if pages <= 1 or not dims:
        return [rows[i : i + page] for i in range(0, len(rows), page)]
    rows = rows[np.argsort(x[rows, dims[0]], kind="stable")]
    each = -(-pages // slabs(pages, len(dims))) * page
    return [run for i in range(0, len(rows), each) for run in packed_runs(x, dims[1:], page, rows[i : i + each])]


def by_spread(x: np.ndarray) -> list[int]:
    return np.argsort(-x.astype(np.float64).var(axis=0), kind="stable").tolist() if len(x) else []


def tile_cuts(sample: np.ndarray, dims: list[int], tiles: int) -> tuple | None:
    """Nested cuts (coordinate, cut points, parts of each slab) of a packing into ``tiles`` tiles, from the quantiles of ``sample``."""
    if tiles <= 1 or not dims or not len(sample):
        return None
    n = slabs(tiles, len(dims))
    sorted_rows = sample[np.argsort(sample[:, dims[0]], kind="stable")]
    parts = np.array_split(sorted_rows, n)
    points = np.array([part[0, dims[0]] for part in parts[1:] if len(part)])
    return dims[0], points, [tile_cuts(part, dims[1:], -(-tiles // n)) for part in parts[: len(points) + 1]]


def n_tiles(cuts: tuple | None) -> int:
    return 1 if cuts is None else sum(map(n_tiles, cuts[2]))


def tiles_of(x: np.ndarray, cuts: tuple | None) -> np.ndarray:
    """The number of each row's tile."""
    out = np.zeros(len(x), np.int32)
    if cuts is None:
        return out
    slab, first = np.searchsorted(cuts[1], x[:, cuts[0]], side="right"), 0
    for i, part in enumerate(cuts[2]):
        own = np.flatnonzero(slab == i)
        out[own] = first + tiles_of(x[own], part)
        first += n_tiles(part)
    return out


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of q with points of each box, coordinate by coordinate; a little wide, as doubles round."""
    q, low, high = (a.astype(np.float64) for a in (q, low, high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


class Tree:
    """An R-tree over packed leaves; nodes are numbered leaves first, the root last. ``order`` tells where its rows stood."""

    def __init__(self, x: np.ndarray, leaf: int, fanout: int):
        runs = packed_runs(x, by_spread(x), leaf, np.arange(len(x)))
        self.order, self.starts = np.concatenate(runs), np.cumsum([0, *map(len, runs)])
        self.x, self.most = x[self.order], int(np.abs(x).max(initial=0))
        self.children: list[range] = []
        low, high = [f.reduceat(self.x, self.starts[:-1]) for f in (np.minimum, np.maximum)]
        lows, highs, first = [low], [high], 0
        while len(low) > 1:
            cut = range(0, len(low), fanout)
            self.children += [range(first + i, first + min(i + fanout, len(low))) for i in cut]
            first += len(low)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            lows, highs = [*lows, low], [*highs, high]
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.doubles = self.x.astype(np.float64)


class Asked:
    """One question to a tree. Scores of a leaf are worked out when it is first visited and serve all of the question's searches."""

    def __init__(self, tree: Tree, q: np.ndarray):
        self.tree, self.q, self.leaves = tree, q, len(tree.starts) - 1
        #: Doubles hold these scores exactly; else they are Python integers.
        self.small = tree.most * int(np.abs(q).max(initial=0)) * max(1, len(q)) < 1 << 53
        self.score = np.zeros(len(tree.x), np.float64 if self.small else object)
        self.visited = np.zeros(self.leaves, bool)

    def _rows(self, leaves: list[int]) -> np.ndarray:
        starts, q = self.tree.starts, self.q
        for leaf in leaves:
            if not self.visited[leaf]:
                own = slice(starts[leaf], starts[leaf + 1])
                self.score[own] = self.tree.doubles[own] @ q if self.small else self.tree.x[own].astype(object) @ q.astype(object)
                self.visited[leaf] = True
        return np.concatenate([np.arange(starts[leaf], starts[leaf + 1]) for leaf in leaves])

    def best(self, bounds: tuple[np.ndarray, np.ndarray], fits: np.ndarray, ids: list, k: int, window: tuple[float, float], least: float) -> list[tuple[int, int]]:
        """The best ``k`` (-score, id) among rows that ``fits`` marks, with scores within ``window`` and not below ``least``; ``bounds`` are the nodes' intervals.

        Leaves are taken from the queue a few at a time, twice as many every time.
        """
        under, over = np.maximum(bounds[0], window[0]), np.minimum(bounds[1], window[1])
        under, over = under.tolist(), over.tolist()
        queue, best, leaves, most = [(-over[-1], len(over) - 1)], [], [], LEAVES_AT_ONCE
        while queue or leaves:
            worth = max(least, -best[-1][0] if len(best) == k else -math.inf)
            if queue and -queue[0][0] >= worth:
                node = heapq.heappop(queue)[1]
                if under[node] > over[node]:
                    continue
                if node < self.leaves:
                    leaves.append(node)
                else:
                    for child in self.tree.children[node - self.leaves]:
                        if over[child] >= worth and over[child] >= under[child]:
                            heapq.heappush(queue, (-over[child], child))
                if len(leaves) < most:
                    continue
            elif not leaves:
                break
            rows, leaves, most = self._rows(leaves), [], 2 * most
            rows = rows[fits[rows]]
            score = self.score[rows]
            good = np.flatnonzero((score >= max(worth, window[0])) & (score <= window[1]))
            if len(good) > k:
                good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
            best = sorted([*best, *[(-int(score[i]), one) for i in good.tolist() for one in ids[self.tree.order[rows[i]]]]])[:k]
        return best


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _ints(column: pa.Array) -> list:
    return [None if v is None else int(v) for v in column.to_pylist()]


def _window(score: int | None, low: int, high: int) -> tuple[float, float]:
    """The whole scores n with low * score <= 100 * n <= high * score; any without score."""
    return (-math.inf, math.inf) if score is None else (-(-low * score // 100), high * score // 100)


def _boxes(cuts, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(tile, rows, low, high, place): the box of each tile over a task's rows, one row a coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            x = _padded(batch["x"], width)
            tile = tiles_of(x, cuts.value)
            for t in np.unique(tile).tolist():
                own = x[tile == t]
                n, low, high = boxes.get(t, (0, own[0], own[0]))
                boxes[t] = n + len(own), np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
        if boxes:
            places = np.arange(width, dtype=np.int32)
            columns = [np.repeat(np.array(list(boxes), np.int32), width), np.repeat([b[0] for b in boxes.values()], width), np.tile(places, len(boxes)), *[np.concatenate([b[i] for b in boxes.values()]) for i in (1, 2)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tile", "n", "place", "low", "high"])

    return run


def _filed(cuts, blocks, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each class under its tile; a tile's classes are dealt to as many blocks as it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = tiles_of(_padded(batch["x"], width), cuts.value)
            block = batch["key"].to_numpy() % blocks.value[tile]
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(block.astype(np.int32)), *[batch[n] for n in ("ids", "label", "x")]], names=["tile", "block", "ids", "label", "x"])

    return run


def _asked(boxes, blocks, begin: int, end: int, low: int, high: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each question under those of its ``begin``-th to ``end``-th best tiles that can still give it something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            under, over = intervals(_padded(batch["x"], width), *boxes.value)
            windows = [_window(s, low, high) for s in _ints(batch["score"])]
            least = np.array([-math.inf if v is None else v for v in _ints(batch["least"])], np.float64)
            first, last = (np.array(w, np.float64)[:, None] for w in zip(*windows, strict=True))
            # doubles may round a window's ends, so these are a little wide too
            first, last = first - np.abs(np.where(np.isfinite(first), first, 0)) * 1e-12, last + np.abs(np.where(np.isfinite(last), last, 0)) * 1e-12
            worth = np.maximum(first, least[:, None] - np.abs(np.where(np.isfinite(least), least, 0))[:, None] * 1e-12)
            top = np.minimum(over, last)
            order = np.argsort(-top, axis=1, kind="stable")[:, begin:end]
            rows = np.repeat(np.arange(batch.num_rows), order.shape[1])
            tile = order.ravel()
            alive = (top[rows, tile] >= worth[rows, 0]) & (under[rows, tile] <= last[rows, 0])
            rows, tile = rows[alive], tile[alive]
            parts = blocks.value[tile]
            rows, tile, ends = np.repeat(rows, parts), np.repeat(tile, parts), np.cumsum(parts)
            block = np.arange(len(rows)) - np.repeat(ends - parts, parts)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), pa.array(block.astype(np.int32)), *[batch[n].take(take) for n in ("ask", "label", "x", "score", "least")]], names=["tile", "block", "ask", "label", "x", "score", "least"])

    return run


def _searched(k: int, same: bool, low: int, high: int, width: int, leaf: int, fanout: int, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best ``k`` rows of a block, of the question's label or of others, for each question that asks it."""

    def run(filed: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[str, int, int]] = []
        if filed.num_rows and asked.num_rows:
            tree = Tree(_padded(filed["x"], width), leaf, fanout)
            labels, ids = np.array(filed["label"].to_pylist(), object), filed["ids"].to_pylist()
            of = {label: labels == label if same else labels != label for label in set(asked["label"].to_pylist())}
            of = {label: own[tree.order] for label, own in of.items()}
            # a question's windows stand together
            for part in asked.sort_by("ask").combine_chunks().to_batches(max_chunksize=256):
                q, known = _padded(part["x"], width), None
                under, over = intervals(q, tree.low, tree.high)
                told = zip(part["ask"].to_pylist(), part["label"].to_pylist(), _ints(part["score"]), _ints(part["least"]), strict=True)
                for i, (ask, label, score, least) in enumerate(told):
                    if known is None or not np.array_equal(known.q, q[i]):
                        known = Asked(tree, q[i])
                    best = known.best((under[i], over[i]), of[label], ids, k, _window(score, low, high), -math.inf if least is None else least)
                    out += [(ask, -s, one) for s, one in best]
        ask, score, one = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"ask": pa.array(ask, pa.string()), "score": pa.array(score, pa.int64()).cast(kind) if kind == pa.int64() else pa.array(score, kind), "id": pa.array(one, pa.int64())})

    return run


class Index:
    """All classes of equal rows, filed under tiles, and the tiles' boxes."""

    def __init__(self, classes: DataFrame, tile_rows: int, most_tiles: int, most_sample: int):
        spark: SparkSession = classes.sparkSession
        self.classes = classes
        size = classes.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
        self.n, self.width = size.n, size.width or 0
        sample = _padded(classes.orderBy("key").limit(most_sample).select("x").toArrow()["x"], self.width)
        cuts = tile_cuts(sample, by_spread(sample), min(most_tiles, -(-self.n // tile_rows)))
        self.cuts = spark.sparkContext.broadcast(cuts)
        told = classes.select("x").mapInArrow(_boxes(self.cuts, self.width), "tile int, n long, place int, low long, high long")
        # one row for each tile and coordinate
        told = told.groupBy("tile", "place").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        tile, place = told["tile"].to_numpy(), told["place"].to_numpy()
        # a tile without rows has a box that no question asks
        low, high, rows = np.full((n_tiles(cuts), self.width), MOST), np.full((n_tiles(cuts), self.width), -MOST), np.ones(n_tiles(cuts), np.int64)
        low[tile, place], high[tile, place], rows[tile] = told["low"].to_numpy(), told["high"].to_numpy(), told["n"].to_numpy()
        self.tiles = np.unique(tile)
        most = int(max(np.abs(low[self.tiles]).max(initial=0), np.abs(high[self.tiles]).max(initial=0)))
        #: Scores are longs where no score can be beyond them.
        self.small = most * most * max(1, self.width) < 1 << 62
        self.boxes = spark.sparkContext.broadcast((low, high))
        self.blocks = spark.sparkContext.broadcast(-(-rows // (2 * tile_rows)))

    def search(self, asks: DataFrame, k: int, same: bool, low: int, high: int, leaf: int = 64, fanout: int = 8, most_asks: int = 20_000, label: str = "found") -> DataFrame:
        """(ask, score, id), the best ``k`` of each of ``asks(ask, label, x, score)``; ties go to the smaller id."""
        kind, sql = (pa.int64(), "bigint") if self.small else (pa.decimal128(38, 0), "decimal(38,0)")
        n_parts = -(-max(1, asks.count()) // most_asks)
        spread, parts = F.pmod(F.xxhash64("ask"), F.lit(n_parts)).cast("bigint"), F.sequence(F.lit(0).cast("bigint"), F.lit(n_parts - 1).cast("bigint"))
        filed = self.classes.mapInArrow(_filed(self.cuts, self.blocks, self.width), "tile int, block int, ids array<long>, label string, x array<long>").withColumn("part", F.explode(parts))
        best, begin, end = None, 0, 4
        found = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
        while begin < self.boxes.value[0].shape[0]:
            if end * 2 >= self.boxes.value[0].shape[0]:
                end = self.boxes.value[0].shape[0]
            asking = asks.withColumn("least", F.lit(None).cast(sql))
            if best is not None:
                asking = asks.join(best.where(F.col("at") == k).select("ask", F.col("score").alias("least")), "ask", "left")
            asking = asking.select("ask", "label", "x", F.col("score").cast(sql).alias("score"), F.col("least").cast(sql).alias("least"))
            asking = asking.mapInArrow(_asked(self.boxes, self.blocks, begin, end, low, high, self.width), f"tile int, block int, ask string, label string, x array<long>, score {sql}, least {sql}").withColumn("part", spread)
            near = filed.groupBy("tile", "block", "part").cogroup(asking.groupBy("tile", "block", "part")).applyInArrow(_searched(k, same, low, high, self.width, leaf, fanout, kind), f"ask string, score {sql}, id long")
            if best is not None:
                near = near.unionByName(best.drop("at"))
            after = stored(near.withColumn("at", F.row_number().over(found)).where(F.col("at") <= k), label)
            if best is not None:
                discard(best)
            best, begin, end = after, end, 4 * end
        return best.drop("at")


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, tile_rows: int = 4_000, most_tiles: int = 4_096, most_sample: int = 50_000) -> DataFrame:
    """Negatives just less near than the positives of each anchor, from ``vectors(vec_id, embedding, label)``.

    A component x counts as floor(scale * x). Anchors are rows whose vec_id is divisible
    by ``anchor_every``; an anchor's positives are the first ``positives`` other rows of
    its label by inner product. For each, the first ``negatives`` rows of other labels
    are returned whose score n satisfies low * p <= 100 * n <= high * p for the
    positive's score p: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Ties go to the smaller id. All results are exact.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no
    part. Rows equal in all three count once; an anchor's own vec_id is none of its
    positives, and an anchor id with several vectors or labels asks once for each. A
    shorter vector counts as filled up with zeros. Components beyond 2**50 after
    scaling count as that, and scores beyond 64 bits are given as the largest or
    smallest long. An empty table, or one without anchors, gives an empty result.
    Other columns are ignored.

    Rows of equal vector and label are filed once, with the smallest ids that can be
    returned, so copies take one place. Cuts come from the ``most_sample`` vectors of
    least hash; all vectors are filed. Beyond ``most_tiles`` tiles of ``tile_rows`` a tile
    holds more, in blocks of twice ``tile_rows`` at most on average, each with an R-tree of its own.
    """
    spark = vectors.sparkSession
    prepare(spark)
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e")).dropna()
    x = x.where(F.forall("e", lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))))
    whole = F.transform("e", lambda v: F.greatest(F.least(F.floor(v * F.lit(float(scale))), F.lit(MOST)), F.lit(-MOST)))
    x = x.select("vec_id", "label", whole.alias("x")).withColumn("key", F.pmod(F.xxhash64("x"), F.lit(1 << 62))).distinct()
    # of each class the smallest ids, cut before the shuffle
    place = F.row_number().over(Window.partitionBy("key", "label", "x").orderBy("vec_id"))
    most = max(positives + 1, negatives)
    classes = x.withColumn("place", place).where(F.col("place") <= most).groupBy("key", "label", "x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes, "vectors")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    name = F.md5(F.concat("label", F.lit("\n"), F.array_join(F.col("x").cast("array<string>"), ",")))
    anchors = x.where(F.col("vec_id") % anchor_every == 0).select("vec_id", name.alias("ask"), "label", "x")
    anchors = stored(anchors, "anchors")
    if anchors.isEmpty():
        return spark.createDataFrame([], empty)
    index = Index(classes, tile_rows, most_tiles, most_sample)
    asks = anchors.select("ask", "label", "x").dropDuplicates(["ask"]).withColumn("score", F.lit(None).cast("bigint"))
    near = index.search(asks, positives + 1, True, low, high, label="positives")
    # an anchor's own class gives its own id too, hence one more than are kept; the negatives of a score are asked for once
    scores = near.select("ask", "score").distinct().where("score >= 0").withColumnRenamed("ask", "of")
    windows = asks.drop("score").join(scores, F.col("ask") == F.col("of")).select(F.concat_ws(":", "ask", F.col("score").cast("string")).alias("ask"), "label", "x", "score")
    windows = stored(windows, "windows")
    far = index.search(windows, negatives, False, low, high, label="negatives")
    saturated = lambda c: F.greatest(F.least(F.col(c), F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("bigint")
    order = Window.partitionBy("vec_id", "ask").orderBy(F.desc("score"), "id")
    pairs = anchors.select("vec_id", "ask").join(near, "ask").where("id <> vec_id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
    pairs = pairs.select(F.concat_ws(":", "ask", F.col("score").cast("string")).alias("ask"), F.col("vec_id").alias("anchor_id"), F.col("id").alias("positive_id"), saturated("score").alias("positive_score"))
    ranked = far.select("ask", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id")).alias("rank"), F.col("id").alias("negative_id"), saturated("score").alias("negative_score"))
    return pairs.join(ranked, "ask").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
