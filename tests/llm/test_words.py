from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from feedlode.llm import words as w
from tests.llm.cases import blank_words, lowered, words_of


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(max_size=60), max_size=8))
def test_equal_words_have_equal_hashes(texts):
    for finder, plain in ((w.Words.between(w.NOT_ALNUM), words_of),
                          (w.Words.between(w.WHITE, lower=False), blank_words),
                          (w.Words.between(w.WHITE), lambda t: blank_words(lowered(t)))):
        hashes, bounds = finder.read(pa.array(texts, pa.string()))
        expected = [plain(t) for t in texts]
        assert np.diff(bounds).tolist() == [len(e) for e in expected]
        flat = [word for e in expected for word in e]
        of = dict(zip(flat, hashes.tolist(), strict=True))
        assert [of[word] for word in flat] == hashes.tolist()
        assert len(set(of.values())) == len(of)


def test_stretches_do_not_matter(monkeypatch):
    texts = pa.array(["many words " * 500, "x" * 5000, "y z"], pa.string())
    whole = w.Words.between(w.WHITE).read(texts)[0]
    monkeypatch.setattr(w, "STRETCH", 64)
    assert (w.Words.between(w.WHITE).read(texts)[0] == whole).all()


def test_ngrams_stay_within_a_text():
    assert w.ngram_starts(np.array([0, 3, 3, 4, 6]), 2).tolist() == [True, True, False, False, True, False]
    assert w.ngram_starts(np.array([0]), 3).tolist() == []


def test_a_slice_of_a_column():
    column = pa.array(["zero", None, "one two", "three"], pa.string()).slice(1)
    hashes, bounds = w.Words.between(w.WHITE).read(column)
    assert bounds.tolist() == [0, 0, 2, 3]
    assert hashes[2] == w.Words.between(w.WHITE).read(pa.array(["three"]))[0][0]
