"""Stupid-backoff scores of documents under the n-gram counts of their own corpus.

Documents are dealt into chunks of bounded size, stored with words as codes. Single
words are counted first, longer n-grams in slices, one after the other, so that the
n-grams of one slice alone are on disk: a slice has the positions whose previous word falls into it, and for these all
that their scores ask for. A chunk cuts its distinct n-grams of the slice, sorted by
their hash, into buckets and gives a row for each bucket: the hashes and their counts.
A bucket adds them up over all chunks and answers each with what the others hold, in
the order of its hashes, so no hash travels back. Last, a chunk meets the answers of
all slices and is scored. So a frequent n-gram travels once per chunk, not once per
occurrence, and no task holds more than a chunk or a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.session import discard, prepare, replayable, stored
from sessionmill.llm.words import from_planes, ipc, mix, opened, planes, split_words, text_batches, word_hashes

BASE = np.uint64(0x9E3779B97F4A7C15)
GRAMS = "key long, chunk long, n long"
#: Characters of a slice for each bucket of an order, of which a word takes about six.
BUCKET_CHARS = 1_500_000
#: Words, and bytes of text, that a chunk works on at a time.
PIECE, PIECE_BYTES = 100_000, 1 << 20
#: Stands for the number of a slice where single words are meant.
WORDS = -1


def _own_counts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often the word of each position occurs in its document, for ``PIECE`` words at a time (or a single document)."""
    own, done, wide = np.empty(len(codes), np.uint32), 0, int(codes.max(initial=0)) + 1
    while done < len(ends):
        first = int(ends[done - 1]) if done else 0
        to = max(done + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
        doc = np.repeat(np.arange(to - done), np.diff(ends[done:to], prepend=first))
        _, same, n = np.unique(doc * wide + codes[first : ends[to - 1]], return_inverse=True, return_counts=True)
        own[first : ends[to - 1]], done = n[same], to
    return own


def _packed(rows: pa.Table) -> pa.Table:
    """A chunk as one row: its documents, the hashes of its words, and the code of each word with its count in the document.

    Texts are split some at a time, so that of most of them the codes alone are held.
    """
    split = [split_words(x["text"]) for x in text_batches(iter(rows.to_batches()), most_bytes=PIECE_BYTES)]
    n = np.concatenate([np.diff(starts) for _, starts, _ in split])
    merged = pa.chunked_array([words for _, _, words in split]).combine_chunks().dictionary_encode()
    firsts = np.cumsum([0, *[len(words) for _, _, words in split]])
    codes, words = [merged.indices.to_numpy()[a : a + len(w)][c] for a, (c, _, w) in zip(firsts[:-1], split, strict=True)], merged.dictionary
    codes = np.concatenate(codes)
    del split, merged
    # frequent words have the small codes
    count = np.bincount(codes, minlength=len(words))
    often = np.argsort(-count, kind="stable")
    rank = np.empty(len(often), np.int32)
    rank[often] = np.arange(len(often))
    codes = rank[codes]
    docs = pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), pa.array(n)], names=["doc_id", "n_words"])
    hashes = pa.RecordBatch.from_arrays([pa.array(np.concatenate([word_hashes(words[i : i + PIECE]) for i in range(0, max(1, len(words)), PIECE)])[often])], names=["hash"])
    placed = pa.RecordBatch.from_arrays([*planes(codes), *planes(_own_counts(codes, np.cumsum(n)))], names=list("abcdefgh"))
    pa.default_memory_pool().release_unused()
    return pa.table({"chunk": pa.array([rows["chunk"][0].as_py()], pa.int64()), **{name: pa.array([ipc(x)], pa.binary()) for name, x in (("docs", docs), ("hashes", hashes), ("codes", placed))}})


def _rows(chunk: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), chunk, np.int64)), pa.array(n.astype(np.int64))], names=["key", "chunk", "n"])


def _told(distinct: np.ndarray, totals: np.ndarray, told: pa.Table) -> np.ndarray:
    """``totals`` of the chunk's own ``distinct`` keys with those of the corpus; n-grams of no other chunk are not told, as the chunk's own are all there are."""
    asked = told["key"].to_numpy().view(np.uint64)
    at = np.searchsorted(distinct, asked)
    if len(asked) and (not len(distinct) or (distinct[np.minimum(at, len(distinct) - 1)] != asked).any()):
        raise ValueError("a task that ran again read other documents: store them first")
    totals[at] = told["total"].to_numpy()
    return totals


def _single_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The key of each distinct word of a chunk, and how often it occurs there."""
    hashes, placed = opened(row["hashes"])["hash"].to_numpy(), opened(row["codes"])
    return mix(hashes + np.uint64(1)) | np.uint64(1), np.bincount(from_planes(placed.columns[:4]), minlength=len(hashes))


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a chunk: key, chunk, n."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, n = _single_keys({c: batch[c][i].as_py() for c in ("hashes", "codes")})
            distinct, place = np.unique(keys, return_inverse=True)
            yield _rows(batch["chunk"][i].as_py(), distinct, np.bincount(place, n, len(distinct)))


def _with_totals(rows: pa.Table, told: pa.Table) -> pa.Table:
    """The chunk again, with the total of each of its words."""
    row = {c: rows[c][0].as_py() for c in ("chunk", "docs", "hashes", "codes")}
    keys, n = _single_keys(row)
    distinct, place = np.unique(keys, return_inverse=True)
    totals = _told(distinct, np.bincount(place, n, len(distinct)).astype(np.int64), told)
    row["hashes"] = ipc(opened(row["hashes"]).append_column("total", pa.array(totals[place])))
    return pa.table({c: pa.array([x], pa.int64() if c == "chunk" else pa.binary()) for c, x in row.items()})


class _Chunk:
    """A chunk, opened once for all its slices; what it holds for each position takes four bytes a value."""

    def __init__(self, row: dict):
        self.docs, words, placed = opened(row["docs"]), opened(row["hashes"]), opened(row["codes"])
        # totals are known once the chunk has met them
        self.hashes, self.totals = words["hash"].to_numpy(), words["total"].to_numpy() if "total" in words.schema.names else None
        self.codes, self.n = from_planes(placed.columns[:4]), self.docs["n_words"].to_numpy()
        # counts in the document are only for those who score
        self.own = None if self.totals is None else from_planes(placed.columns[4:])
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self.place = np.arange(len(self.codes), dtype=np.int32) - np.repeat((np.cumsum(self.n) - self.n).astype(np.int32), self.n)


class _Slice:
    """The n-grams of two words and more of a chunk that the scores of one slice ask for.

    ``asked`` are the positions that are scored: those whose previous word is of the
    slice, and in slice 0 those of first words. ``at`` are, for each order, the positions
    where its n-grams end, and ``keys`` their 64-bit keys. A context ends in a word of
    the slice; other n-grams have one last but one. So the n-gram alone decides on its
    slices, in every chunk alike, and its counts there are complete.
    """

    def __init__(self, chunk: _Chunk, order: int, slices: int, number: int):
        hashes, codes, place = chunk.hashes, chunk.codes, chunk.place
        context = (mix(hashes) % np.uint64(slices) == number)[codes]
        asked = np.concatenate((np.zeros(1, bool), context))[:-1] & (place > 0)
        if number == 0:
            asked |= place == 0
        self.asked = np.flatnonzero(asked)
        self.at, self.keys = [], []
        with np.errstate(over="ignore"):
            for k in range(1, order):
                at = np.flatnonzero((asked | context if k < order - 1 else asked) & (place >= k))
                run, power = hashes[codes[at]], np.uint64(1)
                for back in range(1, k + 1):
                    power *= BASE
                    run += hashes[codes[at - back]] * power
                self.at.append(at)
                self.keys.append(mix(run + np.uint64(k + 1)) | np.uint64(1))


def _chunk_grams(order: int, slices: int, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each distinct n-gram of two words and more of a chunk that the slice asks for: key, chunk, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _Slice(_Chunk({c: batch[c][i].as_py() for c in ("docs", "hashes", "codes")}), order, slices, number)
                for keys in row.keys:
                    yield _rows(batch["chunk"][i].as_py(), *np.unique(keys, return_counts=True))

    return run


def _bytes(values: np.ndarray) -> bytes:
    """Values as their lowest bytes, then the next ones, and so on: upper bytes of small values compress well."""
    wide = "<u4" if int(values.max(initial=0)) < 1 << 32 else "<u8"
    return wide[-1].encode() + values.astype(wide).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(data: bytes | pa.Buffer) -> np.ndarray:
    wide = int(bytes(data[:1]))
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(wide, -1).T).view(f"<u{wide}").reshape(-1).astype(np.uint64)


def _chunk_buckets(grams: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], parts: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``grams`` of a chunk, in ``parts`` batches, as a row for each part and bucket: hashes as steps from one to the next, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in enumerate(grams(batches)):
            keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
            cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            held = [(i, x, y) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if x < y]
            if held:
                cells = [(rows["chunk"][0].as_py(), at % parts, i, _bytes(np.diff(keys[x:y], prepend=np.uint64(0))), _bytes(n[x:y])) for i, x, y in held]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "part", "bucket", "keys", "n"])

    return run


def _bucket_others(rows: pa.Table) -> pa.Table:
    """For each chunk of a bucket, what all others hold of its n-grams, in the order of their hashes."""
    keys, n = [np.cumsum(_values(k), dtype=np.uint64) for k in rows["keys"].to_pylist()], [_values(k) for k in rows["n"].to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), np.uint64)
    np.add.at(totals, place, np.concatenate(n))
    places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    others = [_bytes(totals[at] - own) for at, own in zip(places, n, strict=True)]
    out = pa.table({**{c: rows[c] for c in ("chunk", "part", "bucket")}, "others": pa.array(others, pa.binary())})
    pa.default_memory_pool().release_unused()
    return out


def _joined(told: pa.Table, number: int, part: int, n: int) -> np.ndarray:
    """The answers of all buckets of a slice and part, which are those to the ``n`` hashes that were asked."""
    own = told.filter((pc.field("slice") == number) & (pc.field("part") == part)).sort_by("bucket")
    found = np.concatenate([np.zeros(0, np.int64), *[_values(x.as_buffer()).astype(np.int64) for c in own["others"].chunks for x in c]])
    if len(found) != n:
        raise ValueError("a task that ran again read other documents: store them first")
    return found


def _looked_up(at: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted position, where ``at`` (ascending) holds it, or else zero."""
    if not len(at):
        return np.zeros(len(wanted), np.int64)
    i = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
    return np.where(at[i] == wanted, values[i], 0)


def _chunk_scores(order: int, alpha: float, slices: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        keys, n = _single_keys({c: rows[c][0].as_py() for c in ("hashes", "codes")})
        distinct, place = np.unique(keys, return_inverse=True)
        totals = np.bincount(place, n, len(distinct)).astype(np.int64) + _joined(told, WORDS, 0, len(distinct))
        rows = _with_totals(rows, pa.table({"key": distinct.view(np.int64), "total": totals}))
        chunk = _Chunk({c: rows[c][0].as_py() for c in ("docs", "hashes", "codes")})
        del rows, keys, n, distinct, place, totals
        sums: list[np.ndarray] = []
        for number in range(slices):
            row = _Slice(chunk, order, slices, number)
            scored = row.asked
            before, length = np.maximum(scored - 1, 0), chunk.place[scored]
            # what the document itself holds of the n-gram does not count for it
            held, context = (chunk.totals[chunk.codes[x]] - chunk.own[x] for x in (scored, before))
            # (log of the score) = log_score, less log(words of all other documents) where it came down to single words
            log_score = np.log(np.where(held > 0, held, alpha))
            single = np.ones(len(scored))
            for k, (at, keys) in enumerate(zip(row.at, row.keys, strict=True), 1):
                distinct, place, totals = np.unique(keys, return_inverse=True, return_counts=True)
                elsewhere = _joined(told, number, k - 1, len(distinct))
                _, same, own = np.unique(chunk.doc[at] * np.int64(len(distinct) + 1) + place, return_inverse=True, return_counts=True)
                others = (totals + elsewhere)[place] - own[same]
                held, usable = _looked_up(at, others, scored), length >= k
                hit = usable & (held > 0)
                backed = np.where(usable, np.log(alpha) + log_score, log_score)
                log_score = np.where(hit, np.log(np.where(hit, held, 1)) - np.log(np.where(hit, np.maximum(context, 1), 1)), backed)
                single = np.where(hit, 0.0, single)
                context = _looked_up(at, others, before)
            # the slices are added in their order
            own_sums = [np.bincount(chunk.doc[scored], x, len(chunk.n)).astype(np.float64) for x in (log_score, single)]
            sums = [x + y for x, y in zip(sums, own_sums, strict=True)] if sums else own_sums
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": chunk.docs["doc_id"], "n_words": chunk.docs["n_words"], "log_score": pa.array(sums[0]), "n_single": pa.array(sums[1])})

    return run


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, chunk_chars: int = 8_000_000, slices: int = 8) -> DataFrame:
    """Mean log of the stupid-backoff score of each document's words.

    A word's score is count(n-gram) / count(its context) for the longest n-gram,
    up to ``order`` words, that other documents hold, times ``alpha`` for each
    step to a shorter one; a single word's is count / all words, and ``alpha`` /
    all words for one that no other document holds. Counts are those of all other
    documents: a document's own occurrences are taken off. Words are what stands
    between white space, with A-Z in lower case; n-grams are told apart by 64-bit hashes.

    Returns doc_id, n_words, score (null for texts without words, which null texts
    are too). Repeated rows are documents of their own; a null doc_id stays null;
    other columns are ignored. In a corpus of one document every score is that of
    unknown words. An empty table gives an empty result. The scores are the same with
    any number of ``slices``; more of them take less disk and more jobs.
    """
    spark = docs.sparkSession
    prepare(spark)
    # rows are dealt by where they are read, so they must be read alike again
    docs = replayable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // chunk_chars))
    # rows that are equal in all columns still spread, by the part of the input that they are read from
    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(parts)))
    kinds = "chunk long, docs binary, hashes binary, codes binary"
    chunks = stored(chunked.groupBy("chunk").applyInArrow(_packed, kinds), "chunks")
    buckets, tables = max(1, -(-chars // (slices * BUCKET_CHARS))), []
    for number in (WORDS, *range(slices)):
        grams, of = (_chunk_words, 1) if number == WORDS else (_chunk_grams(order, slices, number), order - 1)
        asked = chunks.mapInArrow(_chunk_buckets(grams, of, buckets), "chunk long, part int, bucket int, keys binary, n binary")
        others = stored(asked.groupBy("part", "bucket").applyInArrow(_bucket_others, "chunk long, part int, bucket int, others binary"), "others")
        tables.append((number, others))
    told = reduce(DataFrame.unionByName, [x.withColumn("slice", F.lit(number)) for number, x in tables]).groupBy("chunk")
    scored = stored(chunks.groupBy("chunk").cogroup(told).applyInArrow(_chunk_scores(order, alpha, slices), "doc_id long, n_words long, log_score double, n_single double"), "scores")
    discard(chunks, *[x for _, x in tables])
    words = scored.agg(F.sum("n_words")).first()[0] or 0
    rest = F.log(F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)))
    return scored.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round((F.col("log_score") - F.col("n_single") * rest) / F.col("n_words"), 6)).alias("score"))
