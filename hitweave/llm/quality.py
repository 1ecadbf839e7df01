"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded: shares of
neighbouring byte classes, repetition and word lengths go through a tanh layer.  Gated attention
(tanh branch times sigmoid branch) weighs the passages; the weighted sum of their codes is scored.
Only documents have labels: the attention learns from them which passages tell.  All layers are
trained together in numpy.

Training reads at most ``PER_CLASS`` labelled rows of either class, whole; held-out rows never.
Defined results: a text without words is one passage without features; without labelled rows of
both classes the score is the share of label 1 (0 if there are no labels); null is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from hitweave.llm.labelled import Adam, scored, sigmoid, training_rows, weights

PER_CLASS = 3000  # the bound of the training sample
PASSAGE = 64
CODE, GATE = 16, 8
EPOCHS = 30
BATCH = 64
THRESHOLD = 0.3

# Byte classes: 0 blank, 1 line feed, 2 lower, 3 upper, 4 digit, 5 full stop or comma, 6 other ASCII, 7 non-ASCII.
_CLASS = np.full(256, 7, np.uint8)
for _c in range(128):
    _CLASS[_c] = (1 if _c in (10, 11, 12, 13) else 0 if _c <= 32 else 2 if chr(_c).islower() else 3 if chr(_c).isupper()
                  else 4 if chr(_c).isdigit() else 5 if chr(_c) in ".," else 6)
FEATURES = 64 + 6
_ODD = 0x9E3779B97F4A7C15


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts (one row each, in order) and the text of each."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    kind = _CLASS[raw]
    blank = kind < 2
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    of = np.searchsorted(ends, begin, "right")
    words = np.bincount(of, minlength=len(texts))
    count = np.maximum(1, -(-words // PASSAGE))  # passages of each text
    base = np.cumsum(count) - count
    text_of = np.repeat(np.arange(len(texts)), count)
    x = np.zeros((len(text_of), FEATURES), np.float32)
    if not len(begin):
        return x, text_of
    place = np.arange(len(begin)) - (np.cumsum(words) - words)[of]  # a word's number in its text
    passage = base[of] + place // PASSAGE
    # Bytes belong to the passage of the word they are in or precede, after a text's last word to its last passage.
    byte_of = passage[np.minimum(np.searchsorted(end, np.arange(len(raw) - 1), "right"), len(begin) - 1)]
    own = np.searchsorted(ends, np.arange(len(raw) - 1), "right")
    byte_of = np.where(text_of[byte_of] == own, byte_of, (base + count - 1)[own])
    pairs = np.bincount(byte_of * 64 + kind[:-1] * 8 + kind[1:], minlength=len(x) * 64).reshape(len(x), 64)
    x[:, :64] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    powers = np.cumprod(np.full(len(raw), _ODD, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw | 32) * powers)))
    word = (sums[end] - sums[begin]) * np.cumprod(np.full(len(raw), pow(_ODD, -1, 1 << 64), np.uint64))[begin]
    n = np.bincount(passage, minlength=len(x))
    some = np.maximum(n, 1)
    again = np.concatenate(([False], (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])))
    second = np.concatenate(([False, False], (word[2:] == word[:-2]) & (passage[2:] == passage[:-2])))[: len(word)]
    order = np.lexsort((word, passage))
    new = np.concatenate(([True], (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
    size = end - begin
    x[:, 64] = np.bincount(passage, again, len(x)) / some
    x[:, 65] = np.bincount(passage, second, len(x)) / some
    x[:, 66] = np.bincount(passage[order], new, len(x)) / some
    x[:, 67] = np.bincount(passage, size, len(x)) / some / 10
    x[:, 68] = np.bincount(passage, size > 20, len(x)) / some
    x[:, 69] = n / PASSAGE
    return x, text_of


def _sums(values: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Sums of consecutive rows by text; every text has a row."""
    return np.add.reduceat(values, np.searchsorted(text_of, np.arange(n)), axis=0)


@dataclass
class Model:
    layers: list[np.ndarray]  # encoder, its bias, tanh gate, sigmoid gate, attention, score, its bias

    def forward(self, x: np.ndarray, text_of: np.ndarray, n: int):
        enc, enc_bias, tan, sig, att, out, bias = self.layers
        code = np.tanh(x @ enc + enc_bias)
        t, s = np.tanh(code @ tan), sigmoid(code @ sig)
        e = (t * s) @ att
        e = np.exp(e - np.maximum.reduceat(e, np.searchsorted(text_of, np.arange(n)))[text_of])
        a = e / _sums(e, text_of, n)[text_of]
        z = _sums(a[:, None] * code, text_of, n)
        return code, t, s, a, z, sigmoid(z @ out + bias[0])

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, text_of = passages(texts)
        return self.forward(x, text_of, len(texts))[-1]


def train(rows: list[tuple[bytes, int]], counts: dict[int, int], seed: int = 1) -> Model:
    y = np.array([label for _, label in rows], np.int64)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    prior = np.log((share + 1e-12) / (1 - share + 1e-12))
    rng = np.random.default_rng(seed)
    shapes = [(FEATURES, CODE), (CODE,), (CODE, GATE), (CODE, GATE), (GATE,), (CODE,), (1,)]
    layers = [rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) if len(s) == 2 or s in ((GATE,), (CODE,)) else np.zeros(s, np.float32)
              for s in shapes]
    layers[1][:] = 0
    layers[-1][:] = prior
    model = Model(layers)
    if len(set(y.tolist())) < 2:
        layers[-2][:] = 0
        return model
    w = weights(y, counts).astype(np.float32)
    bags = [passages([t])[0] for t, _ in rows]
    adam = Adam(layers, 0.01)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            n = len(pick)
            x = np.concatenate([bags[i] for i in pick])
            text_of = np.repeat(np.arange(n), [len(bags[i]) for i in pick])
            code, t, s, a, z, p = model.forward(x, text_of, n)
            enc, enc_bias, tan, sig, att, out, bias = layers
            d = (w[pick] * (p - y[pick]) / n).astype(np.float32)  # to the logit of each text
            to_z = d[:, None] * out
            to_a = (to_z[text_of] * code).sum(1)
            to_e = a * (to_a - _sums(a * to_a, text_of, n)[text_of])
            to_t = to_e[:, None] * att * s * (1 - t * t)
            to_s = to_e[:, None] * att * t * s * (1 - s)
            to_code = a[:, None] * to_z[text_of] + to_t @ tan.T + to_s @ sig.T
            to_in = to_code * (1 - code * code)
            adam.step([x.T @ to_in, to_in.sum(0), code.T @ to_t, code.T @ to_s, ((t * s) * to_e[:, None]).sum(0), z.T @ d, d.sum(keepdims=True)])
    return model


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted`` (and ``key``)."""
    model = train(*training_rows(docs, labels, "quality", per_class, doc_id, text))
    return scored(docs, model.score, THRESHOLD, doc_id, text)
