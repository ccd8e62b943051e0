"""Two-stage suffix sorting and adjacent common prefixes against plain sorting."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orestrata.llm import suffixes as X


def check(raw: bytes, depth: int):
    text = np.frombuffer(raw, dtype=np.uint8)
    words = X.words_at(text, depth)
    got = X.suffix_array(text, depth, words).tolist()
    pad = raw + bytes(depth + 8)
    assert sorted(got) == list(range(len(raw)))
    heads = [pad[i : i + depth] for i in got]
    assert heads == sorted(heads)
    common = X.common_prefixes(np.array(got, dtype=np.int64), words, depth).tolist()
    for k in range(1, len(got)):
        x, y = heads[k - 1], heads[k]
        assert common[k] == next((i for i in range(depth) if x[i] != y[i]), depth)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\x01é", max_size=80), st.sampled_from([8, 20, 100]))
def test_random_texts(text, depth):
    check(text.encode(), depth)


def test_runs_periods_and_long_repeats():
    for raw in (b"", b"a", b"a" * 500, b"ab" * 300, b"abc" * 200 + b"abd" * 200, bytes(range(256)) * 3, b"\xff" * 40 + b"\x01" * 40):
        check(raw, 100)


def test_types_are_those_of_whole_suffixes():
    raw = b"mississippi"
    got = X.smaller_than_successor(np.frombuffer(raw, dtype=np.uint8)).tolist()
    assert got == [raw[i:] < raw[i + 1 :] for i in range(len(raw))]
