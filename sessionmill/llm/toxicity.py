"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Both classes, toxic and ordinary, have counts of the longest character n-grams of
their own; the lower orders, to which rare expressions back off, are Kneser-Ney
continuation counts that the classes share. A word's evidence is its
log-likelihood under the toxic model less that under the ordinary one. A document
is compared on length-normalised evidence: of the whole text, and of its
passages, the strongest of which a long ordinary text cannot dilute. A small
logistic fit on held-back labelled rows turns the comparison into a score.

All counts are exact and stay in Spark. They are joined to the distinct grams of the
corpus, and each chunk of documents gets the evidence of its own grams, so no task
or process holds a table of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.session import discard, prepare, replayable, stored
from sessionmill.llm.words import from_planes, ipc, opened, planes, ragged, segment_max, segment_sum, split_words, text_batches

ORDER = 6
BITS = 10
DISCOUNT = 0.75
SCALE = 1e9
FEATURES = ["whole", "passage", "strongest", "second", "third", "fifth", "size"]
RANKS = (1, 2, 3, 5)
PASSAGE = 8
BATCH_BYTES = 2 << 20
SLICE_WORDS = 250_000
HELD_WORDS = 250_000
GRAM_WORDS = 50_000


def packed_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams of each word's characters with its borders, one per character and one for its end.

    A gram is an integer of ORDER times BITS bits, last character lowest, so the
    suffix of a gram is its low bits and its context is the gram shifted by BITS.
    Border is 0; other characters fold into 1 to 1023. Returns the grams and
    where each word's begin.
    """
    chars = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    fold = (1 << BITS) - 1
    padded = np.zeros(int((length + ORDER).sum()), np.int64)
    begin = np.cumsum(length + ORDER) - (length + ORDER)
    padded[ragged(begin + ORDER - 1, length)] = chars % fold + 1
    at = ragged(begin, length + 1)
    grams = np.zeros(len(at), np.int64)
    for i in range(ORDER):
        grams = (grams << BITS) | padded[at + i]
    return grams, np.concatenate(([0], np.cumsum(length + 1)))


def gram_parts(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The packed grams of GRAM_WORDS words at a time: their arrays take many times the words' own bytes."""
    for first in range(0, len(words), GRAM_WORDS):
        yield packed_grams(words.slice(first, GRAM_WORDS))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the distinct words of each document, by class, summed over HELD_WORDS words at a time."""
    held: list[tuple[pa.Array, np.ndarray]] = []

    def summed() -> pa.RecordBatch:
        known = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
        codes, weight = known.indices.to_numpy(zero_copy_only=False), np.concatenate([w for _, w in held])
        grams, begin = packed_grams(known.dictionary)
        gram, inverse = np.unique(grams, return_inverse=True)
        by_word = [np.bincount(codes, weight[:, i], len(known.dictionary)) for i in (1, 0)]
        counts = [np.bincount(inverse, np.repeat(w, np.diff(begin)), len(gram)).astype(np.int64) for w in by_word]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, *counts)], names=["gram", "toxic", "ordinary"])

    for batch in text_batches(batches, most_bytes=BATCH_BYTES):
        codes, starts, words = split_words(batch["text"])
        toxic = np.repeat(batch["toxic"].to_numpy(zero_copy_only=False) == 1, np.diff(starts))
        pairs = np.unique(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * len(words) * 2 + codes * 2 + toxic)
        use = pairs % (2 * max(1, len(words)))
        held.append((words, np.bincount(use, minlength=2 * len(words)).reshape(-1, 2)))
        if sum(len(words) for words, _ in held) > HELD_WORDS:
            yield summed()
            held.clear()
    if held:
        yield summed()


def _suffix(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND((1 << (BITS * order)) - 1)


def _context(gram: str) -> Column:
    return F.shiftright(gram, BITS)


def train(labelled: DataFrame) -> dict[str, DataFrame]:
    """Exact count tables of both models from ``labelled(text, toxic)``, by gram or context.

    Every labelled row and every gram counts; the tables stay in Spark.
    """
    grams = labelled.select("text", "toxic").mapInArrow(_gram_counts, "gram long, toxic long, ordinary long")
    level = stored(grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
    kinds = [F.sum(c).alias(f"{c}_total") for c in ("toxic", "ordinary")] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("toxic", "ordinary")]
    tables = {"top": level, "context": level.groupBy(_context("gram").alias("context")).agg(*kinds)}
    level = level.select("gram")
    for order in range(ORDER - 1, 0, -1):
        # the next lower order counts the distinct characters before each gram, whichever class they are from
        level = stored(level.groupBy(_suffix("gram", order).alias("gram")).agg(F.count("*").alias("n")), "grams")
        tables[f"shared{order}"] = level
        tables[f"shared_context{order}"] = level.groupBy(_context("gram").alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return tables


def _smoothed(count: str, total: str, kinds: str, lower: str) -> Column:
    own = F.greatest(F.coalesce(F.col(count), F.lit(0)) - F.lit(DISCOUNT), F.lit(0.0))
    return F.when(F.col(total) > 0, (own + F.lit(DISCOUNT) * F.least(F.col(kinds), F.col(total)) * F.col(lower)) / F.col(total)).otherwise(F.col(lower))


def evidence(grams: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(gram, gain) of distinct ``grams``: log-likelihood of the last character under the toxic model less that under the ordinary one, times SCALE."""
    lower = None
    for order in range(1, ORDER):
        asked = grams.select(_suffix("gram", order).alias("gram")).distinct()
        asked = asked.join(tables[f"shared{order}"], "gram", "left").withColumn("context", _context("gram")).join(tables[f"shared_context{order}"], "context", "left")
        if lower is None:
            asked = asked.withColumn("lower", F.lit(1.0 / (1 << BITS)))
        else:
            asked = asked.withColumn("suffix", _suffix("gram", order - 1)).join(lower, "suffix")
        lower = asked.select(F.col("gram").alias("suffix"), _smoothed("n", "total", "kinds", "lower").alias("lower"))
    asked = grams.join(tables["top"], "gram", "left").withColumn("context", _context("gram")).join(tables["context"], "context", "left")
    asked = asked.withColumn("suffix", _suffix("gram", ORDER - 1)).join(lower, "suffix")
    logs = [F.log(F.greatest(_smoothed(c, f"{c}_total", f"{c}_kinds", "lower"), F.lit(1e-12))) for c in ("toxic", "ordinary")]
    return asked.select("gram", F.round((logs[0] - logs[1]) * SCALE).cast("bigint").alias("gain"))


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the task's texts, without most repetitions."""
    held: list[pa.Array] = []

    def distinct() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.unique(packed_grams(pc.unique(pa.concat_arrays(held)))[0]))], names=["gram"])

    for batch in text_batches(batches, most_bytes=BATCH_BYTES):
        held.append(split_words(batch["text"])[2])
        if sum(map(len, held)) > HELD_WORDS:
            yield distinct()
            held.clear()
    if held:
        yield distinct()


def _chunks(carry: list[str], chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's documents as rows of about ``chunk_bytes`` of text each, words as codes: (docs, words, codes), compressed."""

    def packed(held: list[tuple[pa.RecordBatch, np.ndarray, pa.Array]]) -> pa.RecordBatch:
        known = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
        first = np.cumsum([0] + [len(h[2]) for h in held])
        index = known.indices.to_numpy(zero_copy_only=False)
        parts = [index[at : at + len(h[2])] for h, at in zip(held, first, strict=False)]
        # frequent words have the small codes, so their upper bytes compress well
        count = np.zeros(len(known.dictionary), np.int64)
        for h, part in zip(held, parts, strict=True):
            np.add.at(count, part, np.bincount(h[1], minlength=len(part)))
        often = np.argsort(-count, kind="stable")
        rank = np.empty(len(often), "<u4")
        rank[often] = np.arange(len(often), dtype=np.uint32)
        columns = planes(np.concatenate([rank[part][h[1]] for h, part in zip(held, parts, strict=True)]))
        words = " ".join(known.dictionary.take(pa.array(often)).to_pylist())
        docs = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()[0]
        parts = [ipc(docs), ipc(pa.RecordBatch.from_arrays([pa.array([words.encode()], pa.large_binary())], names=["words"])), ipc(pa.RecordBatch.from_arrays(columns, names=["a", "b", "c", "d"]))]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["docs", "words", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_batches(batches, most_bytes=BATCH_BYTES):
            codes, starts, words = split_words(batch["text"])
            held.append((pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(starts)), *[batch[c] for c in carry]], names=["doc_id", "n_words", *carry]), codes.astype(np.int32), words))
            size += pc.sum(pc.binary_length(batch["text"])).as_py() or 0
            if size >= chunk_bytes:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _words(data: bytes) -> pa.Array:
    joined = opened(data)["words"].cast(pa.large_string())
    return pc.split_pattern(joined, " ").flatten() if len(joined[0].as_buffer()) else joined.slice(1)


def compare(codes: np.ndarray, starts: np.ndarray, gain: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """FEATURES of each text, of its words' codes from ``starts[i]`` to ``starts[i + 1]`` and the gain and size of each word.

    Evidence per character of the whole text and of its strongest passage; evidence of the
    strongest distinct words by the root of their length; and the logarithm of
    the number of distinct words, as the strongest of many is large by chance.
    """
    word, length = gain[codes], size[codes]
    whole = segment_sum(word, starts) / np.maximum(segment_sum(length, starts), 1)
    # passages: runs of PASSAGE words from each text's start
    n = np.diff(starts)
    runs = -(-n // PASSAGE)
    cut = np.concatenate((np.repeat(starts[:-1], runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)) * PASSAGE, starts[-1:]))
    passage = segment_sum(word, cut) / np.maximum(segment_sum(length, cut), 1) if len(cut) > 1 else np.zeros(0)
    strongest = segment_max(passage, np.concatenate(([0], np.cumsum(runs))), 0.0)
    return [whole, strongest, *_ranked(codes, starts, gain / np.sqrt(np.maximum(size, 1)))]


def _ranked(codes: np.ndarray, starts: np.ndarray, strength: np.ndarray) -> list[np.ndarray]:
    """The RANKS-th largest strength among each text's distinct words (the smallest where it has fewer, 0 without words), and the logarithm of their number."""
    most, texts = max(1, len(strength)), len(starts) - 1
    by_strength = np.argsort(-strength, kind="stable")
    place = np.empty_like(by_strength)
    place[by_strength] = np.arange(len(by_strength))
    pairs = np.unique(np.repeat(np.arange(texts), np.diff(starts)) * most + place[codes])
    first = np.searchsorted(pairs, np.arange(texts + 1) * most)
    out = []
    for rank in RANKS:
        value, has = np.zeros(texts), np.flatnonzero(np.diff(first))
        value[has] = strength[by_strength[pairs[np.minimum(first[has] + rank, first[has + 1]) - 1] % most]]
        out.append(value)
    return [*out, np.log1p(np.diff(first))]


def _chunk_grams(rows: pa.Table) -> pa.Table:
    grams = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.unique(grams) for w in rows["words"] for grams, _ in gram_parts(_words(w.as_py()))]]))
    return pa.table({"chunk": pa.array(np.full(len(grams), rows["chunk"][0].as_py() if rows.num_rows else 0, np.int64)), "gram": pa.array(grams)})


def _chunk_features(carry: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["doc_id", *FEATURES, *carry]
    kinds = [pa.int64(), *[pa.float64()] * len(FEATURES), *[pa.int64()] * len(carry)]

    def of_chunk(row: dict, known: np.ndarray, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
        gain, size = [np.zeros(0)], [np.zeros(0)]
        for grams, begin in gram_parts(_words(row["words"])):
            at = np.searchsorted(known, grams)
            if not len(known) or (known[np.minimum(at, len(known) - 1)] != grams).any():
                raise ValueError("a task that ran again read other documents: store them first")
            gain.append(segment_sum(gains[at], begin) / SCALE)
            size.append(np.diff(begin).astype(np.float64))
        gain, size = np.concatenate(gain), np.concatenate(size)
        docs, codes = opened(row["docs"]), from_planes(opened(row["codes"]).columns)
        ends = np.cumsum(docs["n_words"].to_numpy())
        first = 0
        while first < docs.num_rows:
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + SLICE_WORDS, side="right")))
            part = docs.slice(first, last - first)
            starts = np.concatenate(([0], ends[first:last] - done))
            features = compare(codes[done : done + int(starts[-1])].astype(np.int64), starts, gain, size)
            yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(x, pa.float64()) for x in features], *[part[c] for c in carry]], names=names)
            first = last

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("gram")
        known, gains = told["gram"].to_numpy(), told["gain"].to_numpy()
        out = [batch for i in range(rows.num_rows) for batch in of_chunk({c: rows[c][i].as_py() for c in ("docs", "words", "codes")}, known, gains)]
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds, strict=True))))

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last one is the constant) by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) / 100 * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) / 100 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, most_fit_rows: int = 20_000, carry: tuple[str, ...] = (), chunk_bytes: int = 24 << 20) -> DataFrame:
    """Scores every whole text of ``docs``; learns from ``labels(doc_id, toxic)``.

    Rows whose crc32(doc_id as text) mod ``folds`` is 0 are held out and never
    learned from. Remainder 1 fits the logistic weights, on the ``most_fit_rows``
    labelled rows of least hash; all other labelled rows are counted by the models.
    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), and
    the compared FEATURES. ``carry`` names long columns of ``docs`` that the result keeps.

    Null or empty texts have no evidence and get the score of none. Null labels are
    not learned from, and a doc_id labelled both ways counts for both. A null
    doc_id is scored, with held_out false. Without labels of both classes every
    score is 0. Repeated rows are scored alike, one output row each; an empty
    table gives an empty result.

    Documents are cut into chunks as their tasks read them, ``chunk_bytes`` of text or
    one longer text each, so no chunk grows with a doc_id's copies. A task that runs
    again must read the same rows in the same order, as scans of files do, so ``docs``
    that come out of a shuffle are stored first.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = replayable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry))
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().distinct()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    tables = train(docs.select("doc_id", "text").where(fold > 1).join(labels.where(fold > 1).hint("merge"), "doc_id"))
    asked = stored(docs.select("text").mapInArrow(_distinct_grams, "gram long").distinct(), "asked")
    gains = stored(evidence(asked, tables), "gains")
    discard(asked, *tables.values())
    chunks = docs.mapInArrow(_chunks(list(carry), chunk_bytes), "docs binary, words binary, codes binary")
    chunks = chunks.select(F.xxhash64("docs", "words", "codes").alias("chunk"), "docs", "words", "codes")
    # the same columns in both uses, so that chunks are made and shuffled once
    told = chunks.groupBy("chunk").applyInArrow(_chunk_grams, "chunk long, gram long").join(gains, "gram")
    kinds = ", ".join(["doc_id long", *[f"{f} double" for f in FEATURES], *[f"{c} long" for c in carry]])
    compared = stored(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_chunk_features(list(carry)), kinds), "evidence")
    sample = compared.where(fold == 1).join(labels.where(fold == 1), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_fit_rows).toPandas()
    score = F.lit(0.0)
    if sample.toxic.nunique() == 2:
        x = sample.sort_values(["doc_id", *FEATURES])
        w = logistic(x[FEATURES].to_numpy(), x.toxic.to_numpy(np.float64)).tolist()
        score = 1 / (1 + F.exp(-sum((F.lit(a) * F.col(f) for a, f in zip(w, FEATURES, strict=False)), F.lit(w[-1]))))
    scored = compared.withColumn("score", score)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES, *carry)
