import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linequarry.llm.textops import Tokenizer, chunks, distinct_sets, shingle_hashes

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))


TEXT = st.text(alphabet="abAB \t\nñ.", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 4))
def test_shingle_sets(texts, width):
    tok, got = Tokenizer(), []
    for i, j, buf, off in chunks(pa.array(texts, pa.string()), 16):
        w = tok.words(buf, off)
        assert [[bytes(buf[a:b]).translate(LOW) for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first, w.first[1:])] == [words(t) for t in texts[i:j]]
        values, bounds = distinct_sets(*shingle_hashes(w, width), j - i)
        got += [frozenset(values[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    want = []
    for t in texts:
        w = words(t)
        want.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    assert [len(g) for g in got] == [len(w) for w in want]
    for a, x in enumerate(got):
        for b, y in enumerate(got):
            assert len(x & y) == len(want[a] & want[b])


@pytest.mark.parametrize("space", [True, False])
def test_long_text_in_pieces(space):
    tok = Tokenizer()
    text = ("word " if space else "x") * 700_000 + " end"
    buf = np.frombuffer(("a b" + text + "c").encode(), np.uint8)
    off = np.array([0, 3, 3 + len(text), 4 + len(text)])
    w = tok.words(buf, off)
    counts = np.diff(w.first)
    assert counts.tolist() == [2, len(text.split()), 1]
    tok.PIECE = 1 << 30
    assert (tok.words(buf, off).hash == w.hash).all()
