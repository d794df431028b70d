import random
import re

import public_tokenizers

from sessionmill.llm.token_counts import WORD, LongestMatch, byte_pieces, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, initial, rest):
    at, n = 0, 0
    while at < len(word):
        pieces = rest if at else initial
        end = next((e for e in range(min(len(word), at + 40), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_matching():
    draw = random.Random(5)
    for _ in range(60):
        word = lambda most: bytes(draw.choice(b"abc") for _ in range(draw.randint(1, most)))
        initial, rest = ({word(5) for _ in range(draw.randint(1, 14))} for _ in range(2))
        if draw.random() < 0.5:
            initial |= {b"a", b"b", b"c"}
            rest |= {b"a", b"b", b"c"}
        words = [b"", *(word(14) for _ in range(150))]
        assert LongestMatch(initial, rest).counts(words).tolist() == [greedy(w, initial, rest) for w in words]
        assert LongestMatch(initial).counts(words).tolist() == [greedy(w, initial, initial) for w in words]
    assert LongestMatch([]).counts([b"", b"x"]).tolist() == [0, 1]


def test_documents(spark):
    pieces = set(byte_pieces(open(PATH, encoding="utf-8").read()))
    texts = ["Hello, WORLD 2024!", None, "", " \n", "naïve été 漢字" * 3, "x" * 40_000, "snake_case a\x1cb \x00", "Hello, WORLD 2024!"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "hi there", 2), (0, texts[0], 3)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), PATH).collect()
    want = []
    for i, t, _ in rows:
        words = [w for c in re.findall(r"[^\x20\x09-\x0d]+", t or "") for w in WORD.findall(c.lower())]
        want.append((i, len(words), sum(greedy(w.encode(), pieces, pieces) for w in words)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
