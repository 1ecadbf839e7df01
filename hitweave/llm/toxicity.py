"""Toxicity by subword-bag embeddings.

A text is the bag of its words' byte n-grams (4, 6 and 8 bytes, a space marking the word's ends) and of
the words whole, each hashed to one of 2^18 vectors; a word said several times in a row counts
once.  Their average, with ``PRIOR``
zero vectors so that a few n-grams alone do not decide, goes to a linear softmax whose bias is the
share of the classes; vectors and softmax are trained together in numpy by gradient descent.  A
misspelt or unseen word shares most of its n-grams with words that were seen, and so their vectors.

As the softmax is linear, scoring needs one number per n-gram: its vector times the difference of
the class weights.

Training reads at most ``PER_CLASS`` labelled rows of either class; held-out rows never.
Defined results: without labelled rows of both classes the score is the share of label 1 (0 if
there are no labels); so it is for a text without n-grams.  Null is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import importable, text_or_empty
from hitweave.llm.labelled import Adam, grouped, scored, sigmoid, training_rows, weights

PER_CLASS = 3000  # the bound of the training sample
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
DIM = 6
SIZES = (4, 6, 8)
EPOCHS = 6
STEPS = 300  # at least, however few rows there are
RATE = 3.0
FLOOR = 1e-7  # rare n-grams learn slowly, or the training texts would be learnt by heart
PRIOR = 200
BATCH = 64

# Lower-cased bytes; everything ASCII that is no letter or digit is a word's end.
_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() or _c >= 128:
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


_ODD = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2^64


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts, repetitions left out: folded bytes, each word between blanks;
    where the words begin; the text of each word."""
    gap = b" "
    data = _FOLD[np.frombuffer(gap + gap.join(texts) + gap, np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    blank = data == 32
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    powers = np.cumprod(np.full(len(data), _ODD, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * powers)))
    back = np.cumprod(np.full(len(data), pow(_ODD, -1, 1 << 64), np.uint64))
    word = (sums[end] - sums[begin]) * back[begin]
    of = np.searchsorted(ends, begin, "right")
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])))[: len(begin)])
    step = np.zeros(len(data) + 1, np.int8)
    step[begin[first] - 1] = 1
    np.add.at(step, end[first], -1)
    kept = np.concatenate((data[np.cumsum(step[:-1]) > 0], np.full(max(SIZES), 32, np.uint8)))
    size = end[first] - begin[first] + 1
    return kept, np.cumsum(size) - size + 1, of[first]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram and word of the texts' bags, and the text each belongs to."""
    data, begin, of = _words(texts)
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    blank = data == 32
    x = data.astype(np.uint32)
    word_of = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin - 1, [len(data)]))))
    ids, at = [], []
    for n in SIZES:
        m = len(x) - n + 1
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= x[j:j + m]
        inside = np.zeros(m, bool)  # a blank between the first and the last byte: not one word
        for j in range(1, n - 1):
            inside |= blank[j:j + m]
        keep = np.flatnonzero(~inside)
        ids.append(h[keep])
        at.append(word_of[keep])
    powers = np.cumprod(np.full(len(x), _ODD & 0xFFFFFFFF, np.uint32), dtype=np.uint32)
    sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(x * powers, dtype=np.uint32)))
    back = np.cumprod(np.full(len(x), pow(_ODD & 0xFFFFFFFF, -1, 1 << 32), np.uint32), dtype=np.uint32)
    end = np.concatenate((begin[1:] - 1, [len(data) - max(SIZES)]))
    ids.append((sums[end] - sums[begin]) * back[begin] + np.uint32(0x5BD1E995))
    at.append(np.arange(len(begin)))
    h = np.concatenate(ids)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), of[np.concatenate(at)]


@dataclass
class Model:
    per_gram: np.ndarray  # vector of each bucket times the difference of the class weights
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        bucket, of = grams(texts)
        sums = np.bincount(of, self.per_gram[bucket], len(texts))
        return sigmoid(sums / (np.bincount(of, minlength=len(texts)) + PRIOR) + self.bias)


def train(rows: list[tuple[bytes, int]], counts: dict[int, int], seed: int = 1) -> Model:
    """Vectors and softmax from labelled texts."""
    y = np.array([label for _, label in rows], np.int64)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    prior = float(np.log((share + 1e-12) / (1 - share + 1e-12)))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    bags = []
    for text, _ in rows:
        ids, n = np.unique(grams([text])[0], return_counts=True)
        bags.append((ids, (n / (n.sum() + PRIOR)).astype(np.float32)))
    w = weights(y, counts)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.array([0, prior], np.float32)
    adam = Adam([softmax], 0.05)
    squares = np.full(BUCKETS, FLOOR, np.float32)  # AdaGrad, one rate per vector
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(bags)))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            ids = np.concatenate([bags[i][0] for i in pick])
            part = np.concatenate([bags[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick])
            mean = np.stack([np.bincount(row, part * vectors[ids, d], len(pick)) for d in range(DIM)], 1)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= (w[pick] / len(pick))[:, None]
            to_mean = p @ softmax.T
            used, slot = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(slot, part * to_mean[row, d], len(used)) for d in range(DIM)], 1)
            squares[used] += (grad * grad).mean(1)
            vectors[used] -= (RATE / np.sqrt(squares[used]))[:, None] * grad
            adam.step([mean.T @ p])
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), prior)


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted`` (and ``key``)."""
    model = train(*training_rows(docs, labels, "toxic", per_class, doc_id, text))
    return scored(docs, model.score, 0.5, doc_id, text)


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = train(*training_rows(docs, labels, "toxic", per_class, doc_id, text))
    importable(docs.sparkSession)

    @F.pandas_udf("int")
    def predicted(texts: pd.Series) -> pd.Series:
        groups = [model.score(g) for g in grouped([bytes(x) for x in texts])]
        return pd.Series((np.concatenate([np.zeros(0), *groups]) >= 0.5).astype(np.int32))

    return docs.filter(predicted(text_or_empty(F.col(f"`{text}`")).cast("binary")) == 0)
