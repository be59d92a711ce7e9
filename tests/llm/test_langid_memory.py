"""Fitting a chain takes little more memory than what it keeps, and the steps it goes in do not matter."""

import random
import tracemalloc

import numpy as np

from sylva.llm import langid


def _texts(n):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 14))) for _ in range(n)]
    return [[words[k::2]] for k in range(2)]


def test_memory_of_a_fit():
    texts = _texts(60_000)
    tracemalloc.start()
    try:
        langid.Chain(["a", "b"]).fit(texts)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 75


def test_steps_do_not_matter(monkeypatch):
    texts = _texts(9_000)
    found = langid.Chain(["a", "b"]).fit(texts)
    monkeypatch.setattr(langid, "FIT_WORDS", 1_000_000)
    whole = langid.Chain(["a", "b"]).fit(texts)
    assert np.array_equal(found.w, whole.w) and np.array_equal(found.step, whole.step)
