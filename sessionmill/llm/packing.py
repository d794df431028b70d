"""Best-fit packing of tokenised documents into sequences, by exact-complement hashing.

Every document becomes pieces of at most ``capacity`` tokens. There are at most
``capacity`` different piece lengths, however many pieces there are, so the plan is
made on the counts by length: a table of patterns (lengths that share a sequence)
with multiplicities, bounded by the capacity alone. Pieces then find their place by
their rank among pieces of the same length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.session import prepare, stored
from sessionmill.llm.words import ragged, segment_sum, split_words, text_batches

END = 1


class WordIds:
    """Token ids of words, each distinct word encoded once (until ``most`` words are held).

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its words. It composes characters before it lower-cases them, so only
    ASCII words are lower-cased here. A word that ends in a Latin-1 letter, which
    both steps leave a letter, and then ASCII sentence marks is encoded as these
    two parts, which the tokenizer separates as well; all others are encoded whole.
    """

    def __init__(self, tokenizer_json: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.most = most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Only the empty entry 0 is left."""
        self.place: dict[str, int] = {}
        self.ids, self.lengths = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        self.known = 1

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(words, range(self.known, self.known + len(words)), strict=True))
        self.known += len(words)
        self.ids.append(ids)
        self.lengths.append(lengths)

    def learn(self, words: list[str]) -> None:
        """Plain lower-case words are one token run each and are encoded many to a text; others one by one."""
        plain = pc.match_substring_regex(pa.array(words, pa.string()), "^[a-zß-öø-ÿ]+$").to_pylist()
        runs = [w for w, p in zip(words, plain, strict=True) if p]
        for a in range(0, len(runs), 2000):
            part = runs[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end each word with an end-of-word token")
            self._add(part, ids, np.diff(ends, prepend=0))
        others = [w for w, p in zip(words, plain, strict=True) if not p]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        self._add(others, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def entries(self, words: list[str]) -> np.ndarray:
        """The entry of each word; what is not known yet is learnt."""
        self.learn([w for w in dict.fromkeys(words) if w not in self.place])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin."""
        if self.known > self.most:
            self.forget()
        codes, starts, words = split_words(texts, lower=False)
        words = pc.if_else(pc.or_(pc.match_substring(words, "<|"), pc.invert(pc.string_is_ascii(words))), words, pc.ascii_lower(words))
        parts = pc.extract_regex(words, r"^(?P<stem>.*[A-Za-zÀ-ÖØ-öø-ÿ])(?P<tail>[,.;:!?]+)$")
        cut = pc.is_valid(parts)
        stems = pc.if_else(cut, pc.struct_field(parts, 0), words).dictionary_encode()
        tails = pc.if_else(cut, pc.struct_field(parts, 1), "").dictionary_encode()
        stem = self.entries(stems.dictionary.to_pylist())[stems.indices.to_numpy(zero_copy_only=False)]
        tail = self.entries(tails.dictionary.to_pylist())[tails.indices.to_numpy(zero_copy_only=False)]
        self.ids, self.lengths = [np.concatenate(self.ids)], [np.concatenate(self.lengths)]
        pair, length = np.column_stack((stem, tail)).ravel(), self.lengths[0]
        flat = self.ids[0][ragged((np.cumsum(length) - length)[pair], length[pair])]
        each = length[stem] + length[tail]
        at = np.cumsum(each) - each
        return flat[ragged(at[codes], each[codes])], np.concatenate(([0], np.cumsum(segment_sum(each[codes], starts))))


def _pieces(tokenizer_json, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = WordIds(tokenizer_json.value)
        for batch in text_batches(batches):
            ids, starts = word_ids.texts(batch["text"])
            row, start, length, crc = [], [], [], []
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                for s in range(0, len(own), capacity):
                    piece = own[s : s + capacity]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
            start = pa.array(start, pa.int64())
            piece = pc.cast(pc.divide(start, capacity), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int32())), piece, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def exact_and_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence, longest first) and how many sequences follow each.

    Exact triples may use up short pieces that more of the long ones could have
    taken, so the plan is made with complements of up to one, two and three
    pieces, and the one of fewest sequences is returned.
    """
    plans = [_plan(counts, capacity, parts) for parts in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


class Sums:
    """The available lengths by what one, two or three of them sum to.

    ``left`` counts the pieces of each length that are still available; it only
    ever decreases, so a combination that has run out is passed over for good.
    """

    def __init__(self, left: list[int], most_parts: int):
        self.left, capacity = left, len(left) - 1
        self.lead = [gap - 2 for gap in range(capacity + 1)]
        if most_parts > 1:
            # (larger, smaller) of every pair that fits, by their sum and then the larger one, longest first;
            # sum by sum, as arrays over all pairs at once would be the most that the driver holds
            have, held = np.flatnonzero(left), np.array(left) > 0
            ends = np.searchsorted(have, np.arange(capacity + 2))
            found = [np.zeros(0, np.int32)]
            for total in range(capacity + 1):
                larger = have[ends[(total + 1) // 2] : ends[total]]
                found.append(larger[held[total - larger]][::-1].astype(np.int32))
            self.larger = memoryview(np.concatenate(found))
            self.at = np.cumsum([0, *map(len, found)])[1:].tolist()
            self.end = self.at[1:]

    def _enough(self, parts: tuple[int, ...]) -> bool:
        return all(self.left[x] >= parts.count(x) for x in parts)

    def single(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        return (gap,) if self._enough((gap, *taken)) else None

    def pair(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """The two lengths of this sum, besides those ``taken``, whose larger is largest."""
        left, first = self.left, self.at[gap]
        for i in range(first, self.end[gap]):
            larger = self.larger[i]
            smaller = gap - larger
            if left[larger] > (larger == smaller) and left[smaller]:
                if larger not in taken and smaller not in taken or self._enough((larger, smaller, *taken)):
                    return larger, smaller
            elif i == first:
                self.at[gap] = first = i + 1
        return None

    def triple(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """The three lengths of this sum whose largest is largest: a leading length and, from the index of pairs, the rest."""
        lead = self.lead[gap]
        while 3 * lead >= gap:
            if self._enough((lead, *taken)) and (found := self.pair(gap - lead, (lead, *taken))):
                return (lead, *found)
            if lead == self.lead[gap] and not (self.left[lead] and self.pair(gap - lead, (lead,))):
                self.lead[gap] -= 1
            lead -= 1
        return None


def _plan(counts: dict[int, int], capacity: int, most_parts: int) -> list[tuple[tuple[int, ...], int]]:
    """One plan, with complements of up to ``most_parts`` pieces.

    From the longest length down, the gap that it leaves is looked up in the index
    of single lengths, then, in further passes, in those of sums of two and of
    three; a combination is consumed as often as its members' counts allow.
    Lengths without an exact complement go best-fit, longest first, into the
    fullest open sequence that takes them.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    sums = Sums(left, most_parts)
    for look_up in (sums.single, sums.pair, sums.triple)[:most_parts]:
        for length in range(capacity, 0, -1):
            while left[length]:
                found = () if length == capacity else look_up(capacity - length, (length,))
                if found is None:
                    break
                pattern = (length, *found)
                times = min(left[x] // pattern.count(x) for x in set(pattern))
                for x in pattern:
                    left[x] -= times
                patterns.append((pattern, times))
    rest = [(x, left[x]) for x in range(capacity, 0, -1) if left[x]]

    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(space: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append((pattern, times))

    for length, n in rest:
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                space, pattern, times = capacity, (), n
            else:
                space = spaces[at]
                pattern, times = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            each = min(space // length, n)
            used = min(times, n // each)
            put(space - each * length, pattern + (length,) * each, used)
            if pattern:
                put(space, pattern, times - used)
            n -= used * each
    return patterns + [x for found in open_.values() for x in found]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[np.ndarray]:
    """For each length and pattern that has it: length, first rank, first sequence, copies per sequence, their offsets (padded)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offsets = np.concatenate(([0], np.cumsum(pattern)[:-1]))
        for length in dict.fromkeys(pattern):
            own = [int(o) for o, x in zip(offsets, pattern, strict=True) if x == length]
            rows.append((length, rank.get(length, 0), sequence, own))
            rank[length] = rank.get(length, 0) + times * len(own)
        sequence += times
    rows.sort(key=lambda r: r[:2])
    copies = np.array([len(r[3]) for r in rows], np.int64)
    return [np.array([r[i] for r in rows], np.int64) for i in range(3)] + [copies, np.cumsum(copies) - copies, np.array([o for r in rows for o in r[3]], np.int64)]


def _placed(plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, base, first, copies, at, offsets = plan.value
        keys = (length << np.int64(44)) + base
        for batch in batches:
            rank = batch["rank"].to_numpy()
            slot = np.searchsorted(keys, (batch["length"].to_numpy() << np.int64(44)) + rank, side="right") - 1
            turn = rank - base[slot]
            sequence = first[slot] + turn // copies[slot]
            offset = offsets[at[slot] + turn % copies[slot]]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, rows_a_bucket: int = 20_000) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document is
    its token ids and then id 1; only longer ones are cut. Returns per piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty texts are the single id 1. Repeated rows and repeated doc_ids
    are documents of their own; a null doc_id stays null. Equal lengths are told
    apart by doc_id and piece. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = stored(docs.mapInArrow(_pieces(tokenizer_json, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(exact_and_best_fit(counts, capacity)))

    # A length that many pieces share is ranked in buckets, each of which knows how many come before it.
    buckets = max(1, sum(counts.values()) // rows_a_bucket)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = pieces.withColumn("own", order).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed
