"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie over bytes. Each node has a failure link, to where
matching goes on after the longest pieces before it are cut off, and the number
of pieces cut off on the way; so a word's greedy word-piece count is found in time
linear in its length and no piece is built.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.session import prepare
from sessionmill.llm.words import segment_sum, split_words, text_batches

WORD = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+|[\x1c-\x1f]+")
NONE = -1


class LongestMatch:
    """Greedy longest-match counts over two piece sets: for a word's start and for its rest.

    A word that cannot be matched to its end counts as one piece.
    """

    def __init__(self, initial: Iterable[bytes], rest: Iterable[bytes] | None = None):
        edges: dict[int, int] = {}
        parent, byte, final = [NONE], [0], [False]

        def insert(root: int, piece: bytes) -> None:
            at = root
            for b in piece:
                key = at << 8 | b
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(at)
                    byte.append(b)
                    final.append(False)
                at = edges[key]
            final[at] = True

        initial = {p for p in initial if p}
        rest = initial if rest is None else {p for p in rest if p}
        self.start, self.inner = 0, 0
        if rest != initial:
            self.inner = 1
            parent.append(NONE)
            byte.append(0)
            final.append(False)
            for piece in sorted(rest):
                insert(self.inner, piece)
        for piece in sorted(initial):
            insert(self.start, piece)

        fail, popped = np.full(len(parent), NONE, np.int64), np.zeros(len(parent), np.int64)
        depth = [0] * len(parent)
        for v in range(len(parent)):
            if parent[v] != NONE:
                depth[v] = depth[parent[v]] + 1
        for v in sorted((v for v in range(len(parent)) if parent[v] != NONE), key=depth.__getitem__):
            if final[v]:
                fail[v], popped[v] = self.inner, 1
                continue
            z, n = fail[parent[v]], popped[parent[v]]
            while z != NONE and (z << 8 | byte[v]) not in edges:
                n += popped[z]
                z = fail[z]
            if z != NONE:
                fail[v], popped[v] = edges[int(z) << 8 | byte[v]], n
        self.fail, self.popped = fail, popped
        self.keys = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[k] for k in self.keys.tolist()], np.int64)

    def _follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word; all words step through the automaton together."""
        length = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.minimum(length, 1)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        node = np.full(len(words), self.start, np.int64)
        failed = np.zeros(len(words), bool)
        for i in range(int(length.max()) if len(words) else 0):
            on = order[: int(np.searchsorted(-length[order], -i, side="left"))]
            on = on[~failed[on]]
            byte = flat[begin[on] + i]
            while len(on):
                to = self._follow(node[on], byte)
                found = to != NONE
                node[on[found]] = to[found]
                on, byte = on[~found], byte[~found]
                out[on] += self.popped[node[on]]
                node[on] = self.fail[node[on]]
                stuck = node[on] == NONE
                failed[on[stuck]] = True
                on, byte = on[~stuck], byte[~stuck]
        on = np.flatnonzero(~failed & (length > 0))
        while len(on := on[(node[on] != self.inner) & (node[on] != self.start)]):
            out[on] += self.popped[node[on]]
            node[on] = self.fail[node[on]]
            failed[on[node[on] == NONE]] = True
            on = on[node[on] != NONE]
        out[failed] = 1
        return out


def byte_pieces(tokenizer_json: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary, without the mark of a word's end."""
    vocabulary = json.loads(tokenizer_json)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    pieces = [token.removesuffix("</w>") for token in vocabulary]
    return [bytes(decode[c] for c in piece) for piece in pieces if all(c in decode for c in piece)]


def _counts(tokenizer_json) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in text_batches(batches):
            automaton = automaton or LongestMatch(byte_pieces(tokenizer_json.value))
            codes, starts, chunks = split_words(batch["text"], lower=False)
            chunks = pc.utf8_lower(chunks).dictionary_encode()
            codes = chunks.indices.to_numpy(zero_copy_only=False)[codes]
            found = [WORD.findall(c) for c in chunks.dictionary.to_pylist()]
            n_words = np.array([len(f) for f in found], np.int64)
            words = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
            pieces = automaton.counts([w.encode() for w in words.dictionary.to_pylist()])
            n_tokens = segment_sum(pieces[words.indices.to_numpy(zero_copy_only=False)], np.concatenate(([0], np.cumsum(n_words))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(segment_sum(n_words[codes], starts)), pa.array(segment_sum(n_tokens[codes], starts))], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Greedy word-piece counts of every whole text: doc_id, n_words, n_tokens.

    Words are, in lower case, runs of letters, single digits and runs of other marks;
    pieces are the byte strings of the vocabulary file, of which every single byte
    is one, so that every word can be matched. Each distinct word of a batch is
    matched once. There is no shuffle.

    Null and empty texts have no words and no tokens. Repeated rows get a row each,
    a null doc_id stays null, other columns are ignored, and an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_counts(tokenizer_json), "doc_id long, n_words long, n_tokens long")
