"""Exact, substring, suffix-array and SimHash deduplication against brute force, with nulls, empty
and repeated rows, ties, empty tables and clashing column names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.llm import exact, sais, simhash, substring, suffix

SCHEMA = "doc_id bigint, text string, key string, id bigint, row string, recipe int, anchor int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "k", 7, "r", 1, 2) for i, t in rows], schema)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sample(seed=1, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(6)] + ["Über", "the", "THE", "ÉTÉ"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 90))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n, 2 * n):
        t = rnd.choice(base)
        kind = rnd.randrange(4)
        if kind == 0:
            t = t.upper() if t.isascii() else t
        elif kind == 1:
            w = t.split(" ")
            w[rnd.randrange(len(w))] = "edit"
            t = " ".join(w)
        elif kind == 2:
            t = t + "\n" + rnd.choice(base)
        rows.append((i, t))
    return rows + [(2 * n, None), (2 * n + 1, ""), (None, base[3]), (5, base[5]), (2 * n + 2, "x" * 9000), (2 * n + 3, "X" * 9000),
                   (2 * n + 4, "ab " * 300)]


@pytest.mark.parametrize("identify", [exact.chunk_id, lambda c: F.length(c) % 2], ids=["hash", "clashing"])
def test_exact_copies(spark, identify):
    rows = sample()
    got = exact.copies(frame(spark, rows), identify=identify).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == max(i for i in ids if i is not None) if any(i is not None for i in ids) else r.keep_id is None
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.deduplicate(frame(spark, rows), identify=identify)
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(lower(r.text) for r in kept.collect()) == sorted(groups)


def test_chunks_are_the_text(spark):
    texts = [t or "" for _, t in sample()] + ["line\r\n" * 2000, "日本" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(F.array_join(exact.chunks(F.col("t")), "") != F.col("t")).isEmpty()


def brute_words(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for k in order:
        rank = (rows[k][0] is None, rows[k][0] or 0)
        for s in range(len(words[k]) - 19):
            w = tuple(words[k][s:s + 20])
            first.setdefault(w, rank)
    out = []
    for k, (i, _) in enumerate(rows):
        rank, seen, gone = (i is None, i or 0), set(), set()
        for s in range(len(words[k]) - 19):
            w = tuple(words[k][s:s + 20])
            if first[w] < rank or w in seen:
                gone |= set(range(s, s + 20))
            seen.add(w)
        kept = b" ".join(x for p, x in enumerate(words[k]) if p not in gone)
        out.append((i, len(words[k]), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(spark, monkeypatch, hot):
    if hot:  # every anchor by the way of the hot ones
        real = substring.with_hot
        monkeypatch.setattr(substring, "with_hot", lambda s: real(s).withColumn("hot", F.lit(True)))
    rows = sample(2)
    got = substring.deduplicated(frame(spark, rows)).drop("kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_words(rows), key=key)


@pytest.mark.parametrize("operator, brute", [(substring, "brute_words"), (suffix, "brute_bytes")], ids=["words", "bytes"])
def test_ids_of_other_types(spark, operator, brute):
    """Ids in the order of their strings, null last."""
    rows = [(i, (t or "") + " shared words of one long passage" * 14 if i is not None and i % 3 == 0 else t) for i, t in sample(4, 15)]
    named = [(None if i is None else f"d{i:05d}", t) for i, t in rows]
    got = operator.deduplicated(spark.createDataFrame(named, "name string, body string"), "name", "body").drop("kept").collect()
    want = [(None if r[0] is None else f"d{r[0]:05d}", *r[1:]) for r in globals()[brute](rows)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and any(r[2] for r in want)


def brute_bytes(rows, n=400):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for s in range(len(d) - n + 1):
            seen[d[s:s + n]] = seen.get(d[s:s + n], 0) + 1
    out = []
    for (i, _), d in zip(rows, data):
        cover = bytearray(len(d))
        for s in range(len(d) - n + 1):
            if seen[d[s:s + n]] > 1:
                cover[s:s + n] = b"\1" * n
        kept = bytes(b for b, c in zip(d, cover) if not c)
        spans = sum(c and not p for c, p in zip(cover, b"\0" + cover))
        out.append((i, len(d), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [suffix.SHARD, 500])
def test_suffix_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD", shard)
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(0, 1500))) for _ in range(12)]
    rows = list(enumerate(base))
    for i in range(12, 40):
        t = rnd.choice(base)
        at = rnd.randrange(len(t) + 1)
        rows.append((i, t[:at] + rnd.choice(["", "!", "edit"]) + t[at:] + rnd.choice(["", rnd.choice(base)])))
    rows += [(50, None), (51, ""), (None, base[1]), (52, "z" * 1000), (53, "ab" * 500), (3, base[3])]
    got = suffix.deduplicated(frame(spark, rows)).drop("kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_bytes(rows), key=key)


def test_suffix_shards_stay_small(spark, monkeypatch):
    """A passage of almost a window in every document: no array gets more than a shard."""
    monkeypatch.setattr(suffix, "SHARD", 8000)
    real, most = suffix.mapped, []

    def measured(df, run, schema):
        if run is suffix._sorted_shards:
            most.append(df.groupBy("anchor", "shard").agg(F.sum(F.length("bytes")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return real(df, run, schema)

    monkeypatch.setattr(suffix, "mapped", measured)
    rnd = random.Random(5)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, ends = some(385), [some(30) for _ in range(4)]
    rows = [(i, some(100) + (rnd.choice(ends) if i % 7 == 0 else "") + passage + (rnd.choice(ends) if i % 5 == 0 else "") + some(100))
            for i in range(120)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, rows[4][1] + "x")]
    got = suffix.deduplicated(frame(spark, rows)).drop("kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_bytes(rows), key=key)
    assert most and max(most) <= suffix.SHARD


def test_suffix_array_and_common_prefixes(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(300):
        monkeypatch.setattr(sais, "VECTOR", 1 if trial % 2 else 400)
        t = np.concatenate((rng.integers(1, rng.integers(2, 7), rng.integers(0, 50)), [0]))
        if trial % 3 == 0:
            t = np.concatenate((t[:-1], t))
        sa, text = sais.suffix_array(t), t.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == want
        shared = sais.permuted_lcp(t, sa, lane=5)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < len(text) - max(a, b) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def brute_fingerprint(text):
    import xxhash
    w = lower(text).encode().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, fps):
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                par[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(rows))]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_simhash(spark, bucket):
    rows = sample(4, 40)
    long = " ".join(f"word{i}" for i in range(400))
    rows += [(200 + i, long.replace(f"word{i * 7} ", f"other{i} ")) for i in range(12)]
    fps = [brute_fingerprint(t) for _, t in rows]
    got = simhash.near_duplicates(frame(spark, rows), bucket=bucket).select("doc_id", "fingerprint", "component_id").collect()
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(rows, fps))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = simhash.deduplicate(frame(spark, rows))
    assert len(kept.columns) == 7
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_links_of_close_fingerprints(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(30):
        x = rnd.getrandbits(64)
        fps |= {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(6)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for bucket in (4096, 3):
        roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 3, bucket)).collect()}
        got = {}
        for f, s in zip(fps, signed):
            got.setdefault(roots.get(s, s), set()).add(f)
        want = {}
        for c, f in zip(brute_components([(k, "") for k in range(len(fps))], fps), fps):
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_hot_buckets_are_dealt_on(spark, monkeypatch):
    """Fingerprints that share 40 bits: no bucket over the limit while it has bits to be dealt by."""
    real, most = simhash.mapped, []

    def measured(df, run, schema):
        if schema == "u bigint, v bigint":
            sizes = df.filter(F.bit_count("mask") < 64 - 12).groupBy("mask", "value").count()
            most.append(sizes.agg(F.max("count")).first()[0] or 0)
        return real(df, run, schema)

    monkeypatch.setattr(simhash, "mapped", measured)
    rnd = random.Random(9)
    fps = sorted({rnd.getrandbits(24) | 0xABCDEF0123 << 24 for _ in range(400)})
    fps = sorted({*fps, *(f ^ sum(1 << b for b in rnd.sample(range(24), 3)) for f in fps[::4])})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 3, 64)).collect()}
    want = brute_components([(k, "") for k in range(len(fps))], fps)
    assert len({(roots.get(s, s), c) for s, c in zip(signed, want)}) == len({roots.get(s, s) for s in signed}) == len(set(want))
    assert max(most) <= 64


def test_links_are_folded(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 500)
    real, held = simhash.forest, []
    monkeypatch.setattr(simhash, "forest", lambda n, left, right: held.append(len(left)) or real(n, left, right))
    fps = np.arange(1024, dtype=np.uint64)  # all of ten bits: one component, 175 links a member
    child, root = simhash.trie_forest(np.zeros(1024, np.int64), fps, 3)
    assert child.tolist() == list(range(1, 1024)) and not root.any()
    assert max(held) < 10_000


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact.copies(none).isEmpty() and exact.deduplicate(none).isEmpty()
    assert substring.deduplicated(none).isEmpty() and suffix.deduplicated(none).isEmpty()
    assert simhash.near_duplicates(none).isEmpty() and simhash.deduplicate(none).isEmpty()
    nulls = frame(spark, [(None, None), (None, None)])
    assert [r.kept for r in exact.copies(nulls).orderBy("kept").collect()] == [False, True]
    assert exact.deduplicate(nulls).count() == 1 and simhash.deduplicate(nulls).count() == 1
    assert substring.deduplicated(nulls).count() == 2 and suffix.deduplicated(nulls).count() == 2
