"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` classifies suffixes as S or L, sorts the leftmost-smaller (LMS) substrings by
inducing, names them, sorts the string of names recursively, and induces the whole array from the
sorted LMS suffixes in linear time.  Inducing goes bucket by bucket: all entries of a character's
bucket at once in numpy, as long as buckets are large; the recursion's large alphabets use plain
loops.  Strings are integer arrays that end with a 0 that occurs nowhere else.
"""

from __future__ import annotations

import numpy as np

VECTOR = 400  # entries per character from which numpy pays


def _types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S-type flags and LMS positions in text order (the last position is one)."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    where = np.where(step != 0, np.arange(n - 1), n - 1)  # the next place where the text changes
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    is_s = np.ones(n, bool)
    is_s[:-1] = step[np.minimum(nearest, n - 2)] > 0
    return is_s, np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _induce(t: np.ndarray, is_s: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """The array induced from LMS positions, which are in the order wanted within each bucket."""
    n = len(t)

    def dealt(p: np.ndarray, queues: list[list[np.ndarray]]) -> None:
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        cut = np.flatnonzero(c[1:] != c[:-1]) + 1
        begin = 0
        for end in [*cut.tolist(), len(p)]:
            queues[c[begin]].append(p[begin:end])
            begin = end

    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    dealt(lms, seeds)
    left: list[list[np.ndarray]] = [[] for _ in range(k)]
    sorted_l: list[np.ndarray] = [np.zeros(0, np.int64)] * k
    for c in range(k):  # L-type suffixes, from the left
        chain, out = left[c], []
        now = np.concatenate(chain) if chain else None
        whole = []
        while now is not None and len(now):
            whole.append(now)
            p = now[now > 0] - 1
            p = p[~is_s[p]]
            same = t[p] == c
            out.append(p[~same])
            now = p[same]
        if whole:
            sorted_l[c] = np.concatenate(whole)
        if seeds[c]:
            s = seeds[c][0]
            out.append(s[s > 0] - 1)
        if out:
            dealt(np.concatenate(out), left)
    right: list[list[np.ndarray]] = [[] for _ in range(k)]
    result: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):  # S-type suffixes, from the right
        whole, out = [], []
        now = np.concatenate(right[c]) if right[c] else None
        while now is not None and len(now):
            whole.append(now)
            p = now[now > 0] - 1
            p = p[is_s[p]]
            same = t[p] == c
            out.append(p[~same])
            now = p[same]
        back = sorted_l[c][::-1]
        p = back[back > 0] - 1
        out.append(p[is_s[p]])
        dealt(np.concatenate(out), right)
        result += whole  # from the right, so far
        result.append(back)
    return np.concatenate([np.array([n - 1]), np.concatenate(result)[::-1]]) if n > 1 else np.zeros(1, np.int64)


def _induce_loop(t: list[int], is_s: list[bool], counts: np.ndarray, lms: list[int]) -> np.ndarray:
    """The same for large alphabets, entry by entry."""
    n = len(t)
    ends = np.cumsum(counts)
    sa, tail = [-1] * n, ends.tolist()
    for p in reversed(lms):
        c = t[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = (ends - counts).tolist()
    for p in sa:  # grows as it is read: every entry is written before its place is reached
        if p > 0 and not is_s[p - 1]:
            c = t[p - 1]
            sa[head[c]] = p - 1
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i]
        if p > 0 and is_s[p - 1]:
            c = t[p - 1]
            tail[c] -= 1
            sa[tail[c]] = p - 1
    sa[0] = n - 1
    return np.array(sa)


def words4(t: np.ndarray) -> np.ndarray:
    """Each symbol (under 2^16) with the three after it in one number; zeros follow the end."""
    x = np.concatenate((t, np.zeros(3, t.dtype))).astype(np.uint64)
    n = len(t)
    return x[:n] | x[1:n + 1] << np.uint64(16) | x[2:n + 2] << np.uint64(32) | x[3:n + 3] << np.uint64(48)


def _names(t: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names, in sorted order, of sorted LMS positions: equal for equal LMS substrings."""
    length = np.zeros(len(t), np.int64)
    length[lms] = np.diff(np.concatenate((lms, [len(t) - 1]))) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    done = 0
    while len(at):  # one symbol at a time, for the pairs that still agree
        at = at[length[a[at]] > done]
        differ = t[a[at] + done] != t[b[at] + done]
        same[at[differ]] = False
        at = at[~differ]
        done += 1
    return np.concatenate(([0], np.cumsum(~same)))


def suffix_array(t: np.ndarray) -> np.ndarray:
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    k = int(t.max()) + 1
    is_s, lms = _types(t)
    if n >= VECTOR * k:
        induce = lambda seeds: _induce(t, is_s, k, seeds)
    else:
        counts, listed, flags = np.bincount(t, minlength=k), t.tolist(), is_s.tolist()
        induce = lambda seeds: _induce_loop(listed, flags, counts, seeds.tolist())
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = induce(lms)
    order = sa[is_lms[sa]]
    names = _names(t, order, lms)
    if names[-1] + 1 < len(lms):
        named = np.zeros(n, np.int64)
        named[order] = names
        order = lms[suffix_array(named[lms])]
    return induce(order)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, limit: int | None = None, lane: int = 32) -> np.ndarray:
    """For each text position, how many symbols its suffix shares with the one before it in the
    suffix array, counted up to a little over ``limit``.  The value falls by at most one from a position to the next, so each lane of
    positions goes on from where the last one ended; all lanes go in step."""
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    w = np.concatenate((words4(t), np.zeros(4, np.uint64)))
    out = np.zeros(n, np.int64)
    start = np.arange(0, n, lane)
    have = np.zeros(len(start), np.int64)
    for step in range(lane):
        i = start + step
        live = np.flatnonzero(i < n)
        i = i[live]
        j = before[i]
        size = np.maximum(have[live] - 1, 0)
        size[j < 0] = 0
        at = np.flatnonzero(j >= 0)
        while len(at):
            # The last symbol occurs once, so no two suffixes agree past the end.
            x = w[np.minimum(i[at] + size[at], n)] ^ w[np.minimum(j[at] + size[at], n)]
            size[at] += np.where(x == 0, 4, (x & np.uint64(0xFFFF) == 0).astype(np.int64)
                                 + (x & np.uint64(0xFFFFFFFF) == 0) + (x & np.uint64(0xFFFFFFFFFFFF) == 0))
            at = at[(x == 0) & ((limit is None) | (size[at] < (limit or 0)))]
        have[live] = size
        out[i] = size
    return out
