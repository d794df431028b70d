"""Word tables of Arrow text batches, shared by the operators that work on words.

All helpers are vectorised: a batch of texts becomes one array of word codes and
the distinct words behind them, so per-word work is done once per distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every input bit reaches every output bit."""
    h = (h ^ (h >> SHIFT)) * MIX_1
    h = (h ^ (h >> SHIFT)) * MIX_2
    return h ^ (h >> SHIFT)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each take at most ``most_bytes`` (or are a single text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space (0x20, 0x09-0x0D) of each text; null texts have none.

    Returns the code of every word, the offset of every text's first word (one
    more at the end) and the distinct words that the codes stand for.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    encoded = listed.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False)))).astype(np.int64)
    blank = pc.index(encoded.dictionary, "").as_py()
    if blank >= 0:
        real = codes != blank
        starts = np.concatenate(([0], np.cumsum(real)))[starts]
        codes = codes[real]
    return codes, starts, encoded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of several runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)


def segment_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values in [starts[i], starts[i+1]); it depends on the values of that run alone."""
    out = np.zeros(len(starts) - 1, dtype=values.dtype)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out


def segment_max(values: np.ndarray, starts: np.ndarray, empty: float) -> np.ndarray:
    """Maximum of values in [starts[i], starts[i+1]), ``empty`` for an empty run."""
    out = np.full(len(starts) - 1, empty, dtype=np.float64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, starts[:-1][full])
    return out


def ipc(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def planes(values: np.ndarray) -> list[pa.Array]:
    """The four bytes of each value as columns of their own: upper bytes of small values compress well."""
    split = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [pa.array(np.ascontiguousarray(split[:, i])) for i in range(4)]


def from_planes(columns: list[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy() for c in columns], axis=1).reshape(-1).view("<u4")
