"""Exact k-means on integer vectors, with bounds that planar geometry loosens.

Every vector carries an upper bound of the distance to its own centroid and a lower
bound of the distance to every other. When centroids move, a lower bound need not
give way by the whole drift: all vectors of a cluster lie in a sphere, and in the
plane of the sphere's centre and the two places of the moved centroid it shows how
much nearer that centroid can have come to any of them (``loosening``). A vector
whose bounds still tell its centroid apart is left alone; for the others the own
distance is worked out, and if that is not enough all distances are, in integers.

Bounds travel with their vectors in a table that is written once a round, so a lost
task is run again from that table. Only the sums of vectors that changed cluster,
the clusters' radii and their sizes are gathered: a few numbers per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.session import discard, prepare, stored

LONGEST = (1 << 63) - 1
#: Relative error that every bound is widened by; far above that of a double.
SLACK = 1e-12
#: Added to the share of a drift that ``loosening`` finds, for the errors of its angles.
ANGLE_SLACK = 1e-7
STATE = "vec_id long, x array<long>, was int, cluster int, upper double, lower array<double>"


def _largest(*arrays: np.ndarray) -> int:
    return max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x from every row of c; Python integers where 64 bits could overflow."""
    width = max(1, x.shape[1])
    most = _largest(x, c)
    if 8 * width * most * most < 1 << 53:
        # all terms are integers that a double holds exactly
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([squared_rows(x, np.broadcast_to(row, x.shape)) for row in c], axis=1)


def squared_rows(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x from the same row of c."""
    most = _largest(x, c)
    kind = np.int64 if 8 * max(1, x.shape[1]) * most * most < 1 << 63 else object
    gap = x.astype(kind) - c.astype(kind)
    return (gap * gap).sum(axis=1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def loosening(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """How much nearer, at most, a centroid that moved from ``old`` to ``new`` is to any point within ``radius`` of ``centre``.

    For a point x, m halfway between both places and t the coordinate of x - m along
    the drift p, |x - old| - |x - new| = 2 |p| t / (|x - old| + |x - new|), and the
    sum is at least 2 |x - m|: so it is |p| cos(x - m, p) at most. In the plane of
    p and the centre, the sphere is seen from m under a known angle, and the point of
    the sphere nearest to the direction of p gives the largest cosine.
    """
    p = new - old
    drift = float(np.linalg.norm(p))
    if drift == 0.0:
        return 0.0
    to_centre = centre - (old + new) / 2
    far = float(np.linalg.norm(to_centre))
    if not radius < far:
        return drift
    along = float(to_centre @ p) / drift
    across = float(np.linalg.norm(to_centre - along * p / drift))
    angle = np.arctan2(across, along) - np.arcsin(radius / far)
    return drift * min(1.0, max(0.0, float(np.cos(max(angle, 0.0)))) + ANGLE_SLACK)


def moved_bounds(upper: np.ndarray, lower: np.ndarray, own: np.ndarray, drift: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds after centroids moved by ``drift``: upper, lower, and the least lower bound of the other centroids."""
    upper = (upper + drift[own]) * (1 + SLACK)
    give = loose[own]
    lower = np.maximum(lower - give - SLACK * (lower + give), 0.0)
    others = lower.copy()
    others[np.arange(len(own)), own] = np.inf
    return upper, lower, others.min(axis=1, initial=np.inf)


def assigned(x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, c: np.ndarray, drift: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its bounds, and how many rows had to be scanned; ``state`` is cluster, upper, lower."""
    if state is None:
        own, upper, lower, scan = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros((len(x), len(c))), np.arange(len(x))
    else:
        own = state[0].copy()
        upper, lower, near = moved_bounds(state[1], state[2], own, drift, loose)
        scan = np.flatnonzero(~(upper < near))
        upper[scan] = _root(squared_rows(x[scan], c[own[scan]])) * (1 + SLACK)
        scan = scan[~(upper[scan] < near[scan])]
    if len(scan):
        d = squared(x[scan], c)
        # argmin takes the first of equals
        best = np.argmin(d, axis=1)
        root = _root(d)
        own[scan], upper[scan], lower[scan] = best, root[np.arange(len(scan)), best] * (1 + SLACK), root * (1 - SLACK)
    return own, upper, lower, len(scan)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _nested(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def _round(told, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, drift, loose = told.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"], np.int64)
            was = np.full(len(x), -1, np.int32) if first else batch["cluster"].to_numpy()
            state = None if first else (was, batch["upper"].to_numpy(), _matrix(batch["lower"], np.float64))
            own, upper, lower, _ = assigned(x, state, c, drift, loose)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["x"], pa.array(was), pa.array(own), pa.array(upper), _nested(lower, pa.float64())], names=["vec_id", "x", "was", "cluster", "upper", "lower"])

    return run


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By cluster: what its sums (places from 0) and its size (place -1) gain in a batch, and the largest upper bound."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, was, own, upper = _matrix(batch["x"], np.int64), batch["was"].to_numpy(), batch["cluster"].to_numpy(), batch["upper"].to_numpy()
        x = x.astype(np.int64 if _largest(x) * len(x) < 1 << 62 else object)
        changed = was != own
        rows = []
        for j in np.union1d(own, was[was >= 0]).tolist():
            came, went = changed & (own == j), changed & (was == j)
            far = float(upper[own == j].max(initial=0.0))
            gain = x[came].sum(axis=0) - x[went].sum(axis=0) if came.any() or went.any() else []
            rows += [(j, -1, Decimal(int(came.sum()) - int(went.sum())), far), *[(j, i, Decimal(int(g)), far) for i, g in enumerate(gain) if g]]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cluster", "place", "gain", "far"])


def _distances(centroids) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch["cluster"].to_numpy()
                d = squared_rows(_matrix(batch["x"], np.int64), centroids.value[own])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array([min(int(v), LONGEST) for v in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """Clusters the rows of ``vectors(vec_id, embedding)`` that have ``width`` components, none null or non-finite.

    A component x counts as floor(scale * x), as a 64-bit integer (larger ones as the
    largest, smaller ones as the smallest). The first centroids are the ``k`` vectors
    of least sha256 of ``seed:vec_id``, in that order (equal ids: by vector; rows
    without vec_id last); each of ``rounds`` rounds assigns all vectors and moves the
    centroids of clusters that are not empty to the floor of their mean, and all are
    assigned once more. Sums, means and distances are exact.

    Returns one row for each kept row, repeated ones and those without vec_id too:
    vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256
    (of its cluster's last centroid, components joined by commas). Ties go to the
    smaller cluster. With fewer than ``k`` vectors there are as many clusters as
    vectors; an empty table gives an empty result. A distance or sum beyond 64 bits
    is given as the largest long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == width)
    x = x.where(F.forall("e", lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))))
    x = x.select("vec_id", F.transform("e", lambda v: F.floor(v * F.lit(float(scale)))).alias("x"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    begin = [r.x for r in x.withColumn("h", hashed).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not begin:
        return spark.createDataFrame([], empty)
    c = np.array(begin, np.int64).reshape(len(begin), width)
    sums, sizes, state = np.zeros(c.shape, object), [0] * len(c), x
    drift, loose = np.zeros(len(c)), np.zeros((len(c), len(c)))
    for turn in range(rounds + 1):
        told = spark.sparkContext.broadcast((c, drift, loose))
        after = stored(state.mapInArrow(_round(told, turn == 0), STATE), "clusters")
        discard(state)
        state = after
        if turn == rounds:
            break
        radius = [0.0] * len(c)
        # at most (width + 1) rows for each centroid
        for r in state.drop("vec_id", "lower").mapInArrow(_changes, "cluster int, place int, gain decimal(38,0), far double").groupBy("cluster", "place").agg(F.sum("gain").alias("gain"), F.max("far").alias("far")).collect():
            radius[r.cluster] = max(radius[r.cluster], r.far)
            if r.place < 0:
                sizes[r.cluster] += int(r.gain)
            else:
                sums[r.cluster, r.place] += int(r.gain)
        moved = np.array([[s // n for s in row] if n else own.tolist() for row, n, own in zip(sums, sizes, c, strict=True)], np.int64)
        drift = np.nextafter(_root(squared_rows(moved, c)) * (1 + SLACK), np.inf)
        old, new = c.astype(np.float64), moved.astype(np.float64)
        loose = np.array([[min(loosening(old[i], radius[i] * (1 + SLACK), old[j], new[j]) * (1 + SLACK), drift[j]) for j in range(len(c))] for i in range(len(c))])
        c = moved
    scored = state.select("vec_id", "x", "cluster").mapInArrow(_distances(spark.sparkContext.broadcast(c)), "vec_id long, cluster int, distance long")
    # one row a centroid
    inertia = {r.cluster: int(r.total) for r in scored.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    told = [(j, min(n, LONGEST), min(sum(inertia.values()), LONGEST), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, n in inertia.items()]
    named = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return scored.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
