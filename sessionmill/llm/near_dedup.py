"""Near-duplicate documents by a chosen-path set-similarity join.

Documents become sets of word shingles. Each independent tree branches the sets
by the minwise tokens at positions that the node draws; nodes that are small
enough are compared exhaustively, larger ones branch again. A pair of similarity
s follows one branch with probability s, so with ``branches`` positions per node
and ``trees`` repetitions a pair at the threshold 0.85 meets in a first-level node with
probability 1 - 0.15 ** (branches * trees); every node below branches as often. Inside a node, minwise signatures
sort out pairs far below the threshold; what is left forms small clusters whose
links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.components import components
from sessionmill.llm.session import prepare, stored
from sessionmill.llm.words import mix, ragged, segment_sum, split_words, text_batches, word_hashes

POSITIONS = 64
BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each text's begin.

    A text of fewer than ``size`` words has its whole sequence as one shingle; a
    text without words has none.
    """
    codes, starts, words = split_words(texts)
    hashes = word_hashes(words)[codes]
    n = np.diff(starts)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at, end = ragged(starts[:-1], count), np.repeat(starts[1:], count)
    with np.errstate(over="ignore"):
        found = np.repeat(np.minimum(n, size).astype(np.uint64), count) * BASE
        power = np.uint64(1)
        for i in range(size):
            inside = at + i < end
            found[inside] += hashes[at[inside] + i] * power
            power *= BASE
        found = mix(found)
    starts = np.concatenate(([0], np.cumsum(count)))
    fresh = np.ones(len(found), bool)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a > 1:
            found[a:b].sort()
            fresh[a + 1 : b] = found[a + 1 : b] != found[a : b - 1]
    return found[fresh], np.concatenate(([0], np.cumsum(fresh)))[starts]


def set_keys(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    with np.errstate(over="ignore"):
        return tuple(segment_sum(mix(sets ^ np.uint64(salt)), starts).view(np.int64) for salt in (0x51ED270B, 0xC2B2AE3D27D4EB4F))


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minwise token (32 bits of its hash) at each of POSITIONS positions; zero for an empty set."""
    out = np.zeros((len(starts) - 1, POSITIONS), np.int32)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        rng = np.random.default_rng(7)
        with np.errstate(over="ignore"):
            for j, (a, b) in enumerate(rng.integers(0, 2**63, (POSITIONS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
                least = np.minimum.reduceat((sets ^ b) * a, starts[:-1][full])
                out[full, j] = (mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _profiles(size: int, carry: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sets, starts = shingle_sets(batch["text"], size)
            a, b = set_keys(sets, starts)
            sig = signatures(sets, starts)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * POSITIONS), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(starts)), pa.array(a), pa.array(b), sig, *[batch[c] for c in carry]], names=["doc_id", "n_shingles", "key_1", "key_2", "sig", *carry])

    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full sets of the rows whose text has the set that their keys stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sets, starts = shingle_sets(batch["text"], size)
            a, b = set_keys(sets, starts)
            same = (a == batch["key_1"].to_numpy()) & (b == batch["key_2"].to_numpy())
            blobs = [sets[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:], strict=True)]
            out = pa.RecordBatch.from_arrays([batch["rep"], batch["cluster"], batch["blocks"], pa.array(blobs, pa.binary())], names=["rep", "cluster", "blocks", "items"])
            yield out.filter(pa.array(same))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key at a time, from rows that are sorted by key."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        at = 0
        for to in [*cuts.tolist(), batch.num_rows]:
            key = tuple(c[at] for c in columns)
            if rest and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(at, to - at))
            last, at = key, to
    if rest:
        yield pa.Table.from_batches(rest)


def local_components(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row that it can reach."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            reached = np.zeros(len(linked), bool)
            reached[i], edge = True, np.array([i])
            while len(edge):
                more = linked[edge].any(axis=0) & ~reached
                reached |= more
                edge = np.flatnonzero(more)
            label[reached] = i
    return label


def _star(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, first row of its component); ids are in ascending order."""
    label = local_components(linked)
    tied = np.flatnonzero(label != np.arange(len(label)))
    return ids[tied], ids[label[tied]]


def _edge_batches(edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for e in edges:
        if len(e[0]):
            held.append(e)
            n += len(e[0])
        if n > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in held])) for i in (0, 1)], names=["u", "v"])
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in held])) for i in (0, 1)], names=["u", "v"])


def alike(sig: np.ndarray, size: np.ndarray, percent: int, slack: float) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose signatures do not rule it out."""
    out = np.zeros((len(sig), len(sig)), bool)
    step = max(1, 2_000_000 // (len(sig) * POSITIONS))
    for a in range(0, len(sig), step):
        b = slice(a, a + step)
        close = (sig[b, None, :] == sig[None, :, :]).sum(axis=2) >= (percent / 100 - slack) * POSITIONS
        out[b] = close & (100 * np.minimum(size[b, None], size[None, :]) >= percent * np.maximum(size[b, None], size[None, :]))
    return out


def _sketch_edges(percent: int, slack: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for group in _groups(batches, ["node", "i", "j"]):
                group = group.combine_chunks()
                ids, sizes = group["rep"].to_numpy(), group["n_shingles"].to_numpy()
                order = np.argsort(ids, kind="stable")
                sig = group["sig"].chunk(0).flatten().to_numpy().reshape(-1, POSITIONS)[order]
                yield _star(ids[order], alike(sig, sizes[order], percent, slack))

        yield from _edge_batches(edges())

    return run


def confirmed(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs of full sets with 100 * intersection >= percent * union."""
    size, owner = np.array([len(s) for s in sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    owner, (_, code) = owner[shared], np.unique(code[shared], return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        part = slice(*np.searchsorted(code, (a, a + 4096)))
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[part], code[part] - a] = 1
        both += has @ has.T
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _exact_edges(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for group in _groups(batches, ["cluster", "i", "j"]):
                ids = group["rep"].to_numpy()
                ids, first = np.unique(ids, return_index=True)
                items = group["items"].take(pa.array(first)).to_pylist()
                yield _star(ids, confirmed([np.frombuffer(x, np.uint64) for x in items], percent))

        yield from _edge_batches(edges())

    return run


def _block_pairs(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows dealt to every pair of blocks of their group, so that any two rows of a group meet in one task.

    Groups of one block stay as they are; a task never holds more than two blocks.
    """
    own = F.pmod(F.xxhash64("rep", F.lit(11)), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks.cast("bigint") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    dealt = df.withColumn("pair", F.explode(pairs)).withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")}).drop("pair")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _leaves(reps: DataFrame, trees: int, branches: int, node_limit: int, levels: int) -> DataFrame:
    """(rep, node, n) of every node of two documents or more that is compared, over all trees."""

    def branch(parents: DataFrame) -> DataFrame:
        """A child for each of the positions that the node draws."""

        def child(k: Column) -> Column:
            place = F.pmod(F.xxhash64("node", k), F.lit(POSITIONS)).cast("int")
            return F.xxhash64("node", place, F.element_at("sig", place + 1))

        drawn = F.array(*map(F.lit, range(branches)))
        return parents.select("rep", F.explode(F.array_distinct(F.transform(drawn, child))).alias("node"))

    roots = reps.withColumn("node", F.explode(F.array(*[F.xxhash64(F.lit(f"tree {t}")) for t in range(trees)])))
    level, found = branch(roots), None
    for depth in range(levels):
        sizes = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        level = stored(level.join(sizes, "node"), "nodes")
        last = depth == levels - 1
        done = level if last else level.where(F.col("n") <= node_limit)
        found = done if found is None else found.union(done)
        large = level.where(F.col("n") > node_limit)
        if last or large.isEmpty():
            return found
        level = branch(large.select("rep", "node").join(reps.select("rep", "sig"), "rep"))
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, trees: int = 3, branches: int = 2, node_limit: int = 4096, block_limit: int = 1000, levels: int = 5, slack: float = 0.2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Components of documents whose shingle sets satisfy 100 * intersection >= percent * union.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored.
    Returns one row per input row: doc_id, n_shingles, component_id (smallest
    doc_id reachable), kept (doc_id = component_id).

    Equal sets form one class up front, so copies never meet in a node. Nodes
    above ``node_limit`` branch again, up to ``levels``. With two branches a pair at
    the threshold is expected to stay together in 1.7 children of each node, and is
    lost from a first-level node with probability 0.031 at most, however many
    levels follow: with three trees it is missed with (0.15 + 0.85 * 0.031) ** 6,
    3e-5, at most. What is still large after the last level, and clusters of
    more than ``block_limit`` sets, are compared in pairs of blocks, so no task
    holds more than two blocks and nothing is capped. ``slack`` is how far a signature's estimate may fall below
    the threshold (over four standard deviations for 64 positions). ``carry`` names
    long columns of ``docs`` that the result keeps.

    Null or empty texts have no shingles and are linked with nothing; they are
    kept. Rows without doc_id are linked with nothing: their component_id is null
    and they are kept. Repeated rows get one output row each, and are compared
    once; a repeated doc_id with several texts ties their components' rows by text, not by id. An empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    kinds = ", ".join(["doc_id long, n_shingles long, key_1 long, key_2 long, sig array<int>", *[f"{c} long" for c in carry]])
    profile = stored(docs.mapInArrow(_profiles(shingle, list(carry)), kinds), "profiles")
    linked = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = stored(linked.groupBy("key_1", "key_2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")

    leaves = _leaves(reps, trees, branches, node_limit, levels)
    blocks = F.ceil(F.col("n") / F.lit(node_limit)).cast("bigint")
    dealt = _block_pairs(leaves.join(reps.select("rep", "n_shingles", "sig"), "rep"), "node", blocks)
    close = dealt.select("rep", "n_shingles", "sig", "node", "i", "j").mapInArrow(_sketch_edges(percent, slack), "u long, v long")

    clusters = components(close).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = stored(clusters.join(reps.select("rep", "key_1", "key_2", "n_shingles"), "rep"), "clusters")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(block_limit)), F.ceil(F.sum("n_shingles") / F.lit(1_000_000))).cast("bigint").alias("blocks"))
    wanted = members.join(sizes, "cluster").select("rep", "cluster", "blocks", "key_1", "key_2")
    texts = docs.join(wanted.hint("merge"), docs.doc_id == wanted.rep).select("rep", "cluster", "blocks", "key_1", "key_2", "text").distinct()
    sets = texts.mapInArrow(_sets(shingle), "rep long, cluster long, blocks long, items binary")
    checked = _block_pairs(sets, "cluster", F.col("blocks")).select("rep", "cluster", "i", "j", "items").mapInArrow(_exact_edges(percent), "u long, v long")

    joined = components(checked)
    of_class = reps.join(joined, reps.rep == joined.node, "left").select("key_1", "key_2", F.coalesce("component", "rep").alias("component_id"))
    known = linked.drop("sig").join(of_class, ["key_1", "key_2"], "left").select("doc_id", "n_shingles", "component_id", *carry)
    alone = profile.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *carry)
    return known.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
