import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from kinfold.llm import textbytes as tb

from .brute import shingles


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t", max_size=40)), max_size=6))
def test_shingles_are_those_of_words(texts):
    h, bounds = tb.shingles(texts)
    for i, t in enumerate(texts):
        own = h[bounds[i] : bounds[i + 1]]
        assert len(set(own.tolist())) == len(shingles(t))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            got = set(h[bounds[i] : bounds[i + 1]].tolist()) & set(h[bounds[j] : bounds[j + 1]].tolist())
            assert len(got) == len(shingles(a) & shingles(b))


@given(st.binary(min_size=1, max_size=60), st.data())
def test_span_hashes_depend_on_bytes_only(raw, data):
    buf = np.frombuffer(raw + raw, np.uint8)
    spans = tb.Spans(buf)
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    n = len(raw)
    assert spans.hash(np.array([a]), np.array([b])) == spans.hash(np.array([a + n]), np.array([b + n]))


def test_slices_cover_everything_once():
    texts = ["x" * 10, None, "y" * 500, "", "z"]
    got = list(tb.slices(texts, 20))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(5))
    assert list(tb.slices([])) == []
