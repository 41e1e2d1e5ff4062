"""The quality classifier is trained on the driver: it may not hold arrays of all words several times."""

import tracemalloc

import numpy as np

from blockloom.llm import quality


def test_training_looks_at_few_words_together(monkeypatch):
    rng = np.random.default_rng(0)
    n = 2000
    y, sizes = rng.integers(0, 2, n), rng.integers(0, 1000, n)
    sizes[5] = 100_000  # more than are looked at together
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = (rng.random(first[-1]) ** 2 * quality.BUCKETS).astype("<u2")
    x = rng.normal(size=(n, len(quality.FEATURES)))
    tracemalloc.start()
    model = quality.train(x, words, first, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(words)  # bytes; eight arrays of whole or real numbers take 64 a word
    good, bad = (np.bincount(words[np.repeat(y, sizes) == k], minlength=quality.BUCKETS) for k in (1, 0))
    assert np.allclose(model.words, np.log((good + 1) / (y.sum() + 2)) - np.log((bad + 1) / ((1 - y).sum() + 2)), atol=1e-12)
    monkeypatch.setattr(quality, "WORDS_TOGETHER", 1 << 30)
    assert (quality.train(x, words, first, y).weights == model.weights).all()
