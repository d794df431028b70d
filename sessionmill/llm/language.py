"""Language by string kernels: how many n-grams two texts have in common, of all lengths up to ORDER.

A text is the set of the n-grams of its words' characters (blended spectrum, by
presence). The normalised kernel of two texts is the number of grams that both hold
over the root of the product of their sizes. A bounded sample of passages is learned
from: a part of it are the landmarks, and a text's kernel values with these give its
Nyström features, on which kernel ridge regression tells each language from all
others. Documents are scored where they lie, in batches of matrix products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.session import prepare
from sessionmill.llm.words import mix, ragged, split_words, text_batches

ORDER = 4
BATCH_BYTES = 2 << 20
#: Cells of a block of the presence matrix.
CELLS = 16 << 20
UNKNOWN = "und"
#: The share of hashes is chosen in steps of one over this.
STEPS = 1 << 30


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the 1- to ORDER-grams of each word with a space on both sides, and where each word's begin.

    The spaces are no grams of their own, so a word of n characters has n grams of length one.
    """
    chars = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    padded = np.full(int((length + 2).sum()), 32, np.uint64)
    begin = np.cumsum(length + 2) - (length + 2)
    padded[ragged(begin + 1, length)] = chars
    # by order, how many grams each word has and where they begin
    counts = [length] + [np.maximum(length + 3 - n, 0) for n in range(2, ORDER + 1)]
    starts = np.concatenate(([0], np.cumsum(sum(counts))))
    out, done = np.empty(int(starts[-1]), np.uint64), np.zeros(len(length), np.int64)
    code = np.zeros(len(padded), np.uint64)
    for n, count in enumerate(counts, 1):
        code = mix(code[: len(padded) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + padded[n - 1 :] + np.uint64(n << 32)) if len(padded) >= n else code[:0]
        out[ragged(starts[:-1] + done, count)] = code[ragged(begin + (n == 1), count)]
        done += count
    return out, starts


def presence(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of texts: (rows, grams in order, matrix of which text holds which gram). Letters in lower case; null texts hold none."""
    codes, starts, words = split_words(texts, lower=False)
    # words that differ in case alone become one
    lowered = pc.utf8_lower(words).dictionary_encode()
    codes, words = lowered.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], lowered.dictionary
    grams, begin = word_grams(words)
    gram, column = np.unique(grams, return_inverse=True)
    pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(starts)) * max(1, len(words)) + codes)
    of, word = pairs // max(1, len(words)), pairs % max(1, len(words))
    size, rows = np.diff(begin), max(1, CELLS // max(1, len(gram)))
    for first in range(0, len(texts), rows):
        last = min(first + rows, len(texts))
        found = np.zeros((last - first, len(gram)), bool)
        own = slice(*np.searchsorted(of, [first, last]))
        n = size[word[own]]
        found[np.repeat(of[own] - first, n), column[ragged(begin[:-1][word[own]], n)]] = True
        yield slice(first, last), gram, found


@dataclass
class Model:
    """What a text is compared with: the landmarks' grams, which of them each landmark holds, and the weights of its kernel values by language."""

    langs: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, gram: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Normalised kernel values of each row of ``found`` with each landmark."""
        at = np.minimum(np.searchsorted(self.grams, gram), max(0, len(self.grams) - 1))
        known = self.grams[at] == gram if len(self.grams) else np.zeros(len(gram), bool)
        shared = found[:, known].astype(np.float32) @ self.landmarks[:, at[known]].astype(np.float32).T
        norm = np.sqrt(np.outer(found.sum(axis=1), self.landmarks.sum(axis=1)).astype(np.float64))
        return shared / np.maximum(norm, 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """For each text and language, near 1 where the text is of the language and near -1 where it is not."""
        out = np.zeros((len(texts), len(self.langs)))
        for rows, gram, found in presence(texts):
            out[rows] = self.kernel(gram, found) @ self.weights
        return out


def fitted(texts: list[str], langs: list[str], is_landmark: np.ndarray, ridge: float) -> Model:
    """One-versus-rest kernel ridge regression on the Nyström features of ``texts``."""
    names = sorted(set(langs))
    picked = pa.array([t for t, use in zip(texts, is_landmark, strict=True) if use], pa.string())
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _, gram, found in presence(picked):
        held += [(gram, row) for row in found]
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *[gram[row] for gram, row in held]]))
    landmarks = np.zeros((len(held), len(grams)), bool)
    for i, (gram, row) in enumerate(held):
        landmarks[i, np.searchsorted(grams, gram[row])] = True
    model = Model(names, grams, landmarks, np.eye(len(held)))
    near = np.concatenate([model.kernel(gram, found) for _, gram, found in presence(pa.array(texts, pa.string()))])
    values, vectors = np.linalg.eigh(near[is_landmark])
    keep = values > 1e-8 * max(values.max(), 1e-8)
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = near @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    model.weights = root @ np.linalg.solve(features.T @ features + ridge * len(texts) * np.eye(features.shape[1]), features.T @ target)
    return model


def _predicted(told) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = Model(*told.value)
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in text_batches(batches, most_bytes=BATCH_BYTES):
            scores = model.scores(batch["text"])
            lettered = batch["lettered"].to_numpy(zero_copy_only=False)
            best = np.where(lettered, np.argmax(scores, axis=1), len(model.langs))
            score = np.where(lettered, np.clip((scores.max(axis=1) + 1) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, folds: int = 5, most_rows: int = 4_000, most_landmarks: int = 128, passage: int = 1_000, ridge: float = 1e-4) -> DataFrame:
    """The language of every whole text of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score.

    Learns from rows with text and lang whose crc32(doc_id as text) mod ``folds`` is not
    0; rows where it is 0 are held_out. Every such document offers one passage of
    ``passage`` characters, at a place that its text's hash chooses; of each language
    the ``most_rows`` over their number of least hash are learned from (one at least),
    equal texts once, and the first ``most_landmarks`` over the number of languages are
    the landmarks. This bounds the model, whatever the table.

    ``lang_pred`` is a learned language, ``und`` where the text is null or has no letter,
    or where nothing could be learned. ``score`` is the regression's estimate that the
    text is of that language, from 0 to 1, and 0 for ``und``; ties go to the first
    language by name. Long texts count as wholes; repeated rows are predicted alike, one
    output row each. A null doc_id is predicted and not held out. An empty table gives
    an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    known = docs.where((fold != 0) & F.col("lang").isNotNull() & lettered).select("lang", "text", F.xxhash64("text").alias("hash"))
    # one row a language
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not sizes:
        return docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    each = max(1, most_rows // len(sizes))
    # twice as many as needed, as hashes are not dealt out evenly
    shares = spark.createDataFrame([(lang, int(min(1.0, 2 * each / n) * STEPS)) for lang, n in sizes.items()], "lang string, share long")
    drawn = known.withColumn("place", F.pmod("hash", F.lit(STEPS))).join(F.broadcast(shares), "lang").where(F.col("place") < F.col("share"))
    part = F.pmod(F.shiftright("hash", 30), F.ceil(F.length("text") / passage))
    drawn = drawn.select("lang", "hash", "place", F.substring("text", (part * passage + 1).cast("int"), F.lit(passage)).alias("text"))
    drawn = drawn.groupBy("lang", "hash", "place").agg(F.any_value("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "hash"))
    rows = drawn.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("lang", "rank").select("lang", "text", "rank").collect()
    model = fitted([r.text for r in rows], [r.lang for r in rows], np.array([r.rank <= max(1, most_landmarks // len(sizes)) for r in rows]), ridge)
    told = spark.sparkContext.broadcast((model.langs, model.grams, model.landmarks, model.weights))
    asked = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text", lettered.alias("lettered"))
    return asked.mapInArrow(_predicted(told), "doc_id long, held_out boolean, lang_pred string, score double")
