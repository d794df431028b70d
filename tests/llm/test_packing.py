import random
import tracemalloc
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sessionmill.llm.packing import END, Sums, WordIds, exact_and_best_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(counts, capacity):
    patterns = exact_and_best_fit(counts, capacity)
    used = {}
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= capacity
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == {k: v for k, v in counts.items() if v}
    return sum(t for _, t in patterns)


def test_plan_uses_every_piece_once_and_stays_near_the_bound():
    rng = np.random.default_rng(3)
    for capacity, n in ((10, 50), (100, 5000), (4096, 20000), (7, 1)):
        lengths = rng.integers(1, capacity + 1, n)
        counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
        got, bound = check_plan(counts, capacity), -(-int(lengths.sum()) // capacity)
        assert got >= bound
        if n >= 5000:
            assert got <= 1.01 * bound + 2


@pytest.mark.parametrize("counts,capacity,expected", [({6: 1, 4: 1}, 10, 1), ({6: 1, 2: 2}, 10, 1), ({5: 1, 2: 1, 1: 1, 3: 0}, 10, 1), ({7: 2, 1: 6}, 10, 2), ({3: 1000}, 10, 334), ({}, 10, 0), ({10: 4}, 10, 4), ({4: 1, 1: 2}, 10, 1), ({5: 1, 3: 1, 1: 2}, 10, 1)])
def test_small_plans(counts, capacity, expected):
    assert check_plan(counts, capacity) == expected


def test_pack_equals_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = ["Hello, world! It's 3.14 (really?).", None, "", "  \n\t ", "ÉLAN vital;; naïve... l'été", "a" * 3000, "x, " * 4000, "<|endoftext|> <|ENDOFTEXT|>.", "İstanbul é. 漢字、かな", "Hello, world! It's 3.14 (really?).", "don't. 's' 'Re you\x1cthere\x0b!"]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "no id", "extra"), (3, "again", "extra"), (3, "again", "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack(df, PATH, capacity=128).toPandas()
    assert len(got) and (got.length <= 128).all()
    want = []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, END]
        want += [(i, s // 128, s, len(ids[s : s + 128]), zlib.crc32(np.array(ids[s : s + 128], "<u4").tobytes())) for s in range(0, len(ids), 128)]
    rows = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 128


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_of_every_character_beside_sentence_marks():
    """Each assigned character before and after each mark, and after capitals that compose with it only in lower case."""
    with open(PATH, encoding="utf-8") as f:
        words = WordIds(f.read(), most=10**9)
    marks = ",.;:!?"
    for low in range(0, 0x20000, 0x4000):
        chars = [chr(c) for c in range(low, low + 0x4000) if unicodedata.category(chr(c)) not in ("Cn", "Cs") and not chr(c).isspace()]
        texts = [t for i, c in enumerate(chars) for t in (f"a{c}{marks[i % 6]}", f"{c}{marks[(i + 1) % 6]}b", f"{'JHTWYI'[i % 6]}{c}{marks[i % 6]}")]
        flat, starts = words.texts(pa.array(texts, pa.string()))
        want = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        wrong = [t for t, w, a, b in zip(texts, want, starts[:-1], starts[1:], strict=True) if flat[a:b].tolist() != w.ids]
        assert not wrong, wrong[:5]


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_near_the_best_of_small_tables(seed):
    """No search of all packings does better by more than one sequence, nor at all where pieces fill sequences exactly."""
    draw = random.Random(seed)
    capacity = 12
    if seed % 2:
        pieces = [draw.randint(1, capacity) for _ in range(draw.randint(1, 8))]
    else:
        pieces = []
        for _ in range(3):
            cuts = sorted(draw.sample(range(1, capacity), draw.randint(0, 1)))
            pieces += [b - a for a, b in zip([0, *cuts], [*cuts, capacity], strict=True)]

    def fewest(rest, spaces):
        if not rest:
            return len(spaces)
        options = [fewest(rest[1:], [*spaces[:i], s - rest[0], *spaces[i + 1 :]]) for i, s in enumerate(spaces) if s >= rest[0]]
        return min([*options, fewest(rest[1:], [*spaces, capacity - rest[0]])])

    counts = {x: pieces.count(x) for x in set(pieces)}
    best, got = fewest(sorted(pieces, reverse=True), []), check_plan(counts, capacity)
    assert best <= got <= best + seed % 2


def test_pairs_of_lengths_are_indexed_in_little_memory():
    tracemalloc.start()
    sums = Sums([0] + [1] * 4096, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    for total in (0, 1, 2, 3, 9, 4095, 4096):
        assert sums.larger[sums.at[total] : sums.end[total]].tolist() == list(range(total - 1, (total - 1) // 2, -1))
