"""The classifiers' features, scores and gradients, recomputed plainly for a few texts."""

import math

import numpy as np
import pytest

from hitweave.llm import quality, toxicity

TEXTS = [b"", b"   \n", b"a", b"Abcdef ghijkl, ABCDEF abcdef", "naïve Straße-日本語 x1y2z3".encode(), b"one two one two two two three", b"word " * 40,
         b"vile vilest! viler... the END", b"A.B.C the the quick, quick brown-fox"]


def plain_grams(text: bytes) -> list[int]:
    """Buckets of a text: the n-grams of every word between blanks, and every word; a word that repeats the one before it is left out."""
    folded = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in text)
    words = [w for w in folded.split(b" ") if w]
    words = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
    out = []
    for w in words:
        marked = b" " + w + b" "
        hashes = []
        for n in toxicity.SIZES:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i:i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                hashes.append(h)
        odd = toxicity._ODD & 0xFFFFFFFF
        hashes.append((sum(c * pow(odd, j, 1 << 32) for j, c in enumerate(w)) + 0x5BD1E995) & 0xFFFFFFFF)
        for h in hashes:
            h ^= h >> 15
            out.append((h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - toxicity.BUCKET_BITS))
    return sorted(out)


def test_toxicity_features_and_scores():
    bucket, of = toxicity.grams(TEXTS)
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), -0.7)
    scores = model.score(TEXTS)
    for i, t in enumerate(TEXTS):
        bag = plain_grams(t)
        assert sorted(bucket[of == i].tolist()) == bag, t
        z = sum(float(model.per_gram[b]) for b in bag) / (len(bag) + toxicity.PRIOR) - 0.7
        assert abs(scores[i] - 1 / (1 + math.exp(-z))) < 1e-6


class Stop(Exception):
    pass


def first_step(module, monkeypatch, rows, counts):
    """The arrays and gradients of the first training step."""
    held = {}

    class Caught:
        def __init__(self, arrays, rate):
            held["arrays"] = arrays

        def step(self, grads):
            held["grads"] = [np.array(g, np.float64) for g in grads]
            raise Stop

    monkeypatch.setattr(module, "Adam", Caught)
    with pytest.raises(Stop):
        module.train(rows, counts)
    return held["arrays"], held["grads"]


def test_quality_gradient_is_the_slope_of_the_loss(monkeypatch):
    rows = [(t + b" and some more words to fill a passage of text", i % 2) for i, t in enumerate(TEXTS)]
    counts = {0: 30, 1: 10}
    layers, grads = first_step(quality, monkeypatch, rows, counts)
    w = quality.weights(np.array([y for _, y in rows]), counts)
    layers = [a.astype(np.float64) for a in layers]
    x, text_of = quality.passages([t for t, _ in rows])

    def loss():
        p = quality.Model(layers).forward(x.astype(np.float64), text_of, len(rows))[-1]
        return sum(-wi * math.log(pi if y else 1 - pi) for (_, y), pi, wi in zip(rows, p, w)) / len(rows)

    rng = np.random.default_rng(1)
    for layer, grad in zip(layers, grads):
        assert layer.shape == grad.shape
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in layer.shape)
            kept, e = layer[at], 1e-5
            layer[at] = kept + e
            up = loss()
            layer[at] = kept - e
            down = loss()
            layer[at] = kept
            assert abs((up - down) / (2 * e) - grad[at]) < 1e-4 + 1e-2 * abs(grad[at])


def test_toxicity_softmax_gradient_is_the_slope_of_the_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "RATE", 0.0)  # the vectors stay as they begin
    rows, counts = [(t, i % 2) for i, t in enumerate(TEXTS)], {0: 30, 1: 10}
    (softmax,), (grad,) = first_step(toxicity, monkeypatch, rows, counts)
    w = toxicity.weights(np.array([y for _, y in rows]), counts)
    vectors = np.random.default_rng(1).normal(0, 0.1, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32).astype(np.float64)
    softmax, prior = softmax.astype(np.float64), math.log(10 / 30)

    def loss():
        total = 0.0
        for (t, y), wi in zip(rows, w):
            bag = plain_grams(t)
            mean = vectors[bag].sum(0) / (len(bag) + toxicity.PRIOR)
            z = mean @ softmax + np.array([0, prior])
            total -= wi * (z[y] - math.log(np.exp(z).sum()))
        return total / len(rows)

    for d in range(toxicity.DIM):
        for c in (0, 1):
            kept, e = softmax[d, c], 1e-4
            softmax[d, c] = kept + e
            up = loss()
            softmax[d, c] = kept - e
            down = loss()
            softmax[d, c] = kept
            assert abs((up - down) / (2 * e) - grad[d, c]) < 1e-5 + 1e-2 * abs(grad[d, c])
