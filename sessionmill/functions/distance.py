"""Edit distances of one string to many at a time, in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that the tables for one set of strings take at most; longer sets are compared in parts.
TABLE_BYTES = 1 << 25


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def distances(texts: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each of ``texts`` its edit distances to ``others``, in parts: number of the text, number of the first other, distances.

    The columns of the table of distances are bits of words, one for each other string
    (Myers, Hyyro): a letter of the text costs a fixed number of operations on all others
    at once. Texts that come sorted share the columns of the start that they have in common.
    """
    longest, deepest = (max((len(t) for t in many), default=0) for many in (others, texts))
    kind = np.uint32 if longest <= 32 else np.uint64
    bits = kind().itemsize * 8
    words = max(1, -(-longest // bits))
    letters, flat = np.unique(np.concatenate([np.zeros(0, np.uint32), *others]), return_inverse=True)
    coded = []
    for text in texts:
        code = np.searchsorted(letters, text)
        known = letters[np.minimum(code, len(letters) - 1)] == text if len(letters) else np.zeros(len(text), bool)
        coded.append(np.where(known, code, len(letters)).tolist())
    ends = np.cumsum([0, *map(len, others)])
    width = max(1, TABLE_BYTES // ((len(letters) + 2 * deepest + 8) * words * kind().itemsize))
    for begin in range(0, len(others), width):
        ends_here = ends[begin : begin + width + 1]
        yield from _part(coded, flat[ends_here[0] : ends_here[-1]], np.diff(ends_here), len(letters), begin, kind, bits, words, deepest)


class Strings:
    """Strings that are compared with each other; ``lengths``, no less than their numbers of letters, are those that a share of edits is told of."""

    #: Letters of a string that fits a word; longer ones are compared in full.
    MOST = 64

    def __init__(self, texts: list[np.ndarray], lengths: np.ndarray):
        self.texts, self.lengths, self.sizes = texts, lengths, np.array([len(t) for t in texts], np.int64)
        self.letters, flat = np.unique(np.concatenate([np.zeros(0, np.uint32), *texts]), return_inverse=True)
        self.codes = np.split(flat, np.cumsum(self.sizes)[:-1])
        self.short = self.sizes <= self.MOST
        self.kind = kind = np.uint32 if self.sizes[self.short].max(initial=0) <= 32 else np.uint64
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        fits = self.short[owner]
        owner, bit = owner[fits], np.left_shift(kind(1), at[fits].astype(kind))
        # where a letter stands in each string, and where any does
        self.places, self.used = np.zeros((len(self.letters), len(texts)), kind), np.zeros(len(texts), kind)
        np.bitwise_or.at(self.places, (flat[fits], owner), bit)
        np.bitwise_or.at(self.used, owner, bit)

    def distances(self, some: np.ndarray, others: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strings of ``some`` and of ``others`` and their distances: all pairs within ``share`` of the longer length, and few besides.

        A distance is no less than the longer number of letters without those of the longest
        common subsequence, which takes a quarter of the operations (Hyyro) and leaves few
        pairs of which the distance is needed. If ``some`` come sorted, they share what their
        common starts give.
        """
        deepest, long = self.sizes[some].max(initial=0), others[~self.short[others]]
        others = others[self.short[others]]
        width = max(1, TABLE_BYTES // ((len(self.letters) + deepest + 8) * self.kind().itemsize))
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] + [self._candidates(some, others[first : first + width], share, deepest) for first in range(0, len(others), width)]
        one, other = map(np.concatenate, zip(*pairs, strict=True))
        found = [(one, other, self._edits(one, other))]
        for number, first, edits in distances([self.texts[n] for n in some], [self.texts[n] for n in long]) if len(long) else ():
            found.append((np.full(len(edits), some[number]), long[first : first + len(edits)], edits))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _candidates(self, some: np.ndarray, others: np.ndarray, share: float, deepest: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose common subsequences are long enough."""
        places, used, sizes, lengths = self.places.take(others, axis=1), self.used[others], self.sizes[others], self.lengths[others]
        # after each letter of a text, the bits that are no step of the subsequence
        free, met = list(np.zeros((deepest + 1, len(others)), self.kind)), np.empty(len(others), self.kind)
        free[0][:] = ~self.kind(0)
        places, one, other, before = list(places), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        limits: dict[tuple[int, int], np.ndarray] = {}
        for number in some.tolist():
            code, same = self.codes[number].tolist(), 0
            while same < min(len(before), len(code)) and before[same] == code[same]:
                same += 1
            for t in range(same, len(code)):
                now, then = free[t], free[t + 1]
                np.bitwise_and(now, places[code[t]], out=met)
                np.add(now, met, out=then)
                np.subtract(now, met, out=met)
                np.bitwise_or(then, met, out=then)
            before, size = code, (len(code), int(self.lengths[number]))
            if size not in limits:
                longer = np.maximum(size[1], lengths)
                most = np.floor(share * longer).astype(np.int64) + 1
                most -= most / np.maximum(longer, 1) > share
                limits[size] = np.clip(most - np.maximum(size[0], sizes) + sizes, -1, 127).astype(np.int8)
            np.bitwise_and(free[len(code)], used, out=met)
            hit = (np.bitwise_count(met).view(np.int8) <= limits[size]).nonzero()[0]
            if len(hit):
                one.append(np.full(len(hit), number))
                other.append(others[hit])
        return np.concatenate(one), np.concatenate(other)

    def _edits(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The distance of each pair (Myers, Hyyro)."""
        edits = np.zeros(len(one), np.int64)
        # longer texts come first, so that those not yet at their end are a slice
        order = np.argsort(-self.sizes[one], kind="stable")
        for first in range(0, len(order), TABLE_BYTES // 128):
            part = order[first : first + TABLE_BYTES // 128]
            left, right = one[part], other[part]
            texts, number = np.unique(left, return_inverse=True)
            deepest = self.sizes[texts].max(initial=0)
            table = np.zeros((len(texts), deepest), np.int64)
            for n, text in enumerate(texts):
                table[n, : self.sizes[text]] = self.codes[text]
            up, down = self.used[right], np.zeros(len(part), self.kind)
            for t, k in enumerate(np.searchsorted(-self.sizes[left], -np.arange(deepest)).tolist()):
                here, vp, vn = self.places[table[number[:k], t], right[:k]], up[:k], down[:k]
                diagonal = (((here & vp) + vp) ^ vp) | here | vn
                rises, falls = ((vn | ~(diagonal | vp)) << self.kind(1)) | self.kind(1), (diagonal & vp) << self.kind(1)
                down[:k], up[:k] = rises & diagonal, falls | ~(rises | diagonal)
            more, less = (np.bitwise_count(x & self.used[right]).astype(np.int64) for x in (up, down))
            edits[part] = self.sizes[left] + more - less
        return edits


def _part(coded: list[list[int]], flat: np.ndarray, lengths: np.ndarray, unknown: int, begin: int, kind: type, bits: int, words: int, deepest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    word, bit = at // bits, np.left_shift(kind(1), (at % bits).astype(kind))
    # where a letter stands in each string; the last row is of letters that none has
    places, used = np.zeros((unknown + 1, words, n), kind), np.zeros((words, n), kind)
    np.bitwise_or.at(places, (flat, word, owner), bit)
    np.bitwise_or.at(used, (word, owner), bit)
    up, down = (np.zeros((deepest + 1, words, n), kind) for _ in range(2))
    up[0] = used
    diagonal, rises, falls, eq = (np.empty(n, kind) for _ in range(4))
    before: list[int] = []
    for number, text in enumerate(coded):
        same = 0
        while same < min(len(before), len(text)) and before[same] == text[same]:
            same += 1
        for t in range(same, len(text)):
            rise: np.ndarray | np.integer = kind(1)
            fall: np.ndarray | None = None
            for w in range(words):
                vp, vn, here = up[t, w], down[t, w], places[text[t], w]
                if fall is not None:
                    here = np.bitwise_or(here, fall, out=eq)
                np.bitwise_and(here, vp, out=diagonal)
                np.add(diagonal, vp, out=diagonal)
                np.bitwise_xor(diagonal, vp, out=diagonal)
                np.bitwise_or(diagonal, here, out=diagonal)
                np.bitwise_or(diagonal, vn, out=diagonal)
                np.bitwise_or(diagonal, vp, out=rises)
                np.invert(rises, out=rises)
                np.bitwise_or(rises, vn, out=rises)
                np.bitwise_and(diagonal, vp, out=falls)
                out = (rises >> kind(bits - 1), falls >> kind(bits - 1)) if w + 1 < words else (kind(1), None)
                np.left_shift(rises, kind(1), out=rises)
                np.bitwise_or(rises, rise, out=rises)
                np.left_shift(falls, kind(1), out=falls)
                if fall is not None:
                    np.bitwise_or(falls, fall, out=falls)
                np.bitwise_and(rises, diagonal, out=down[t + 1, w])
                np.bitwise_or(diagonal, rises, out=diagonal)
                np.invert(diagonal, out=diagonal)
                np.bitwise_or(diagonal, falls, out=up[t + 1, w])
                rise, fall = out
        before = text
        more, less = (np.bitwise_count(x[len(text)] & used).sum(axis=0, dtype=np.int32) for x in (up, down))
        yield number, begin, len(text) + more - less
