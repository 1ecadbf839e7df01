"""Lexical search, source mixing and centroid clustering against brute force, with nulls, empty and
repeated rows, ties, empty tables and clashing column names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.llm import clusters, lexical, mixing

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, item_id bigint, item int, terms string, n int, rank int"


def folded(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, k):
    words = [(i, Counter(folded(t))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n_docs, n_terms = len(words), sum(sum(c.values()) for _, c in words)
    held = {}
    for i, t in items:
        held.setdefault(i, set()).update(folded(t))
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, terms in held.items():
        scores = []
        for i, c in words:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def search_rows(seed=3):
    rnd = random.Random(seed)
    words = ["the", "The", "THE", "café", "CAFÉ", "x1", "日本", "a", "ab", "abc", "b", "bc", "Σ", "ς", "zz z"]
    gaps = [" ", ", ", "\n", "-", "_", "  ", "\t.", "\x7f"]
    docs = [(i, "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    docs += [(200 + i, "the café abc") for i in range(20)] + [(7, docs[7][1]), (None, "the abc zz"), (None, None), (300, None), (301, ""),
                                                            (302, " .,;-_ "), (303, "abc " * 50_000 + "x" * 300_000 + " the")]
    items = [(1, "The abc, the ABC"), (2, "café"), (2, "b"), (3, None), (4, "unseen words"), (5, "--"), (None, "Σ 日本"), (6, "the the café bc a x1"),
             (6, "the the café bc a x1")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"block_items": 2}, {"block_bytes": 8}], ids=["one block", "few items a block", "few bytes a block"])
def test_ranking(spark, limits, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 64)
    docs, items = search_rows()
    frame = spark.createDataFrame([(i, t, 1, 2, "t", 3, 4) for i, t in docs], DOCS).repartition(5)
    wanted = spark.createDataFrame([(i, t, 9, 9, 9) for i, t in items], "item_id bigint, text string, doc_id int, term int, block int")
    got = lexical.ranked(frame, wanted, k=15, **limits)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranking(docs, items, 15)


def test_ranking_of_other_ids_and_empty_tables(spark):
    docs, items = search_rows()
    frame = spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in docs], "name string, body string")
    wanted = spark.createDataFrame([(f"i{i}", t) for i, t in items], "q string, body string")
    got = lexical.ranked(frame, wanted, k=5, doc_id="name", text="body", item_id="q", item_text="body").collect()
    plain = brute_ranking([(None if i is None else f"d{i}", t) for i, t in docs if i is not None], [(f"i{i}", t) for i, t in items], 5)
    assert {r["q"] if "q" in r else r["item_id"] for r in got} == {x[0] for x in plain}
    assert lexical.ranked(frame.limit(0), wanted, doc_id="name", text="body", item_id="q", item_text="body").count() == 0
    assert lexical.ranked(frame, wanted.limit(0), doc_id="name", text="body", item_id="q", item_text="body").count() == 0


# ---------------------------------------------------------------------------

MIX = "doc_id bigint, text string, source string, size string, u int, tie int, number int, left int, z int, words int"


def brute_targets(words, weights=(5, 2, 1), copies=3):
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped = {}
    while True:
        rest, w = sum(words.values()) - sum(stopped.values()), sum(weight[s] for s in order if s not in stopped)
        more = {s: copies * words[s] for s in order if s not in stopped and copies * words[s] * w < rest * weight[s]}
        if not more:
            return {s: float(stopped[s]) if s in stopped else weight[s] * rest / max(w, 1) for s in order}
        stopped |= more


def brute_mixture(rows, fill=256, odds=lambda i: 1.0):
    """Sorted (doc_id, size, target, taken); rows are taken one by one in Pareto order."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    words = Counter()
    for n, (_, _, s) in zip(size, rows):
        words[s] += n
    target, out = brute_targets(words), []
    for s in words:
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        whole = min(3, int(target[s] // words[s])) if words[s] else 0
        room = int(target[s] - whole * words[s]) if whole < 3 else 0
        keyed = []
        for k in mine:
            i, t, _ = rows[k]
            u = (int(hashlib.md5(f"7:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            if room and size[k]:
                p = room / words[s]
                q = (u / (1 - u)) / (p / (1 - p) * odds(i))
                keyed.append((q / (1 + q), k))
        keyed.sort()
        extra, at = set(), 0
        while at < len(keyed) and size[keyed[at][1]] <= room:
            room -= size[keyed[at][1]]
            extra.add(keyed[at][1])
            at += 1
        for _, k in [x for x in keyed[at:] if size[x[1]] <= room][:fill]:
            if size[k] <= room:
                room -= size[k]
                extra.add(k)
        out += [(rows[k][0], size[k], target[s], size[k] * (whole + (k in extra))) for k in mine]
    return sorted(out, key=repr)


def mix_rows(seed=5, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "B", "é", "😀", "￿", None])
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 3, 10, 50, 400])) + rnd.choice(["", "\n", "\x0b "]), s))
    rows += [(1000, "tiny source", "tiny"), (1001, None, "none"), (1002, "", "none"), (None, "null id", None), (None, None, None)]
    return rows + [(5, "twice the same row", "hot")] * 40 + [(None, None, "hot")] * 20


def mixed_rows(spark, rows, **more):
    frame = spark.createDataFrame([(i, t, s, "x", 1, 2, 3, 4, 5, 6) for i, t, s in rows], MIX).repartition(6, F.rand())
    return mixing.mixture(frame, **more)


def test_mixture(spark):
    rows = mix_rows()
    got = [tuple(r) for r in mixed_rows(spark, rows).select("doc_id", "size", "target", "taken").collect()]
    assert sorted(got, key=repr) == brute_mixture(rows)
    again = [tuple(r) for r in mixed_rows(spark, rows[::-1]).select("doc_id", "size", "target", "taken").collect()]
    assert sorted(again, key=repr) == sorted(got, key=repr)


def test_mixture_meets_its_targets(spark):
    rows = mix_rows(8, 900)
    got = mixed_rows(spark, rows).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size
        left = mine[0].target - sum(r.taken for r in mine)
        whole = min(r.copies for r in mine if r.size) if mine[0].source_size else 3
        assert 0 <= left and all(r.size > left for r in mine if r.size and r.copies == whole < 3)  # none that would still fit
        assert all(0 <= r.taken <= 3 * r.size for r in mine)


def test_mixture_with_odds(spark):
    rows = [(i, "one two three", "s") for i in range(400)] + [(i, "one two three", "t") for i in range(400, 1200)]
    likely = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.5)
    got = mixed_rows(spark, rows, odds=likely).select("doc_id", "size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=repr) == brute_mixture(rows, odds=lambda i: 4.0 if i % 2 == 0 else 0.5)
    extra = [r for r in got if r.doc_id >= 400 and r.taken > 0]
    assert sum(r.doc_id % 2 == 0 for r in extra) > 1.5 * sum(r.doc_id % 2 for r in extra) > 0


def test_mixture_of_little(spark):
    assert mixed_rows(spark, mix_rows()).limit(0).count() == 0
    empty = spark.createDataFrame([], MIX)
    assert mixing.mixture(empty).count() == 0
    assert [(r.target, r.taken) for r in mixed_rows(spark, [(1, None, "a"), (2, " ", None)]).collect()] == [(0.0, 0), (0.0, 0)]
    assert [(r.target, r.taken) for r in mixed_rows(spark, [(1, "a b c", "a")]).collect()] == [(3.0, 3)]


def test_mixture_stays_in_the_jvm(spark):
    import contextlib
    import io
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        mixed_rows(spark, mix_rows()[:50]).explain("formatted")
    assert not re.search("Python|Arrow|ExistingRDD", text.getvalue())


# ---------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, cluster string, v int, n int, distance string"


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in hashed[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    own = Counter()
    for _, d, j in found:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for i, d, j in found), key=repr)


def vector_rows(seed=2, n=400, spread=0.3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, 64))
    rows = [(i, (centres[i % 9] + spread * rnd.normal(size=64)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[4][1]) for i in range(60)] + [rows[3]] * 5 + [(None, rows[8][1]), (None, None), (2000, None), (2001, []), (2002, [0.5] * 63),
             (2003, [0.5] * 65), (2004, [math.nan] + [0.0] * 63), (2005, [math.inf] * 64), (2006, [None] + [0.0] * 63), (2007, [-0.0] * 64)]
    return rows


def clustered(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, "c", 1, 2, "d") for i, v in rows], VECTORS).repartition(5)
    out = clusters.clustered(frame, **more)
    return sorted(map(tuple, out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_clusters(spark, spread):
    rows = vector_rows(spread=spread)
    assert clustered(spark, rows) == brute_clusters(rows)


def test_clusters_with_ties(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([0.0, 1 / 64]) for _ in range(2)] + [0.0] * 62) for i in range(90)]  # few points, equal centroids
    assert clustered(spark, rows) == brute_clusters(rows)
    assert clustered(spark, rows, k=5, rounds=1) == brute_clusters(rows, 5, 1)


def test_clusters_of_little(spark):
    rows = vector_rows()
    assert clustered(spark, rows[:3]) == brute_clusters(rows[:3])
    assert clustered(spark, [(1, None)]) == [] and clusters.clustered(spark.createDataFrame([], VECTORS)).count() == 0
    far = [(1, [1e300] * 64), (2, [-1e300] * 64)]
    assert [r[2] for r in clustered(spark, far, k=1, rounds=0)] in ([0, 64 * 4 * clusters.LIMIT**2], [64 * 4 * clusters.LIMIT**2, 0])


def test_orchard_measures_less_than_all():
    rnd = np.random.default_rng(1)
    centroids = rnd.integers(-1000, 1000, (200, 8))
    points = centroids[rnd.integers(0, 200, 500)] + rnd.integers(-5, 5, (500, 8))
    search = clusters.Orchard(centroids)
    found, distance = search.nearest(points)
    full = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert (found == full.argmin(1)).all() and (distance == full.min(1)).all()
