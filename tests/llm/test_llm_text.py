"""Decontamination, tokens, page text, archives, classifiers and the pipeline: brute force, exact
round trips, literal cases and held-out accuracy, with nulls, empty and repeated rows, empty
tables and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.llm import decontam, html_text, quality, spm, toxicity, warc
from hitweave.llm.common import ascii_lower
from hitweave.llm.registry import pieces_model
from hitweave.session import scratch_path

SCHEMA = "doc_id bigint, text string, key string, lang string, items string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "l", "i") for i, t in rows], SCHEMA)


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def key(r):
    return tuple((x is not None, x) for x in r)


def test_ascii_lower(spark):
    rnd = random.Random(1)
    texts = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xC0, 0x250), 0x130, 0x212A, 0x3A3, 0x1F88, 0xA7DC, 0x10570]))
                     for _ in range(rnd.randrange(20))) for _ in range(500)]
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = spark.createDataFrame([(t, t.translate(table)) for t in texts], "t string, want string")
    assert df.filter(ascii_lower(F.col("t")) != F.col("want")).isEmpty()


def brute_contamination(rows, bench):
    windows = {}
    for item, t in bench:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s:s + 13]), set()).add(None if item is None else str(item))
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[s:s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    items |= found
        items = sorted(items - {None})
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, short):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "straße", "K", "İx", "THE"]
    some = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    bench = [(i, some(rnd.randint(13, 30))) for i in range(12)] + [(20, None), (21, ""), (None, some(15)), (3, some(14))]
    if short:
        bench += [(30, "w1 w2 w3"), (31, "THE"), (32, some(7)), (33, some(12))]
    rows = []
    for i in range(60):
        t = some(rnd.randint(0, 60))
        for _ in range(rnd.randrange(3)):
            b = (rnd.choice(bench)[1] or "").split()
            at = rnd.randrange(len(b) + 1)
            t += "; " + " ".join(b[at // 2:]).upper() + ". " + some(rnd.randint(0, 30))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (None, bench[0][1]), (5, rows[5][1]), (5, bench[1][1]), (102, "!!! ???")]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontam.contamination(frame(spark, rows), items).select(*names).collect()
    want = brute_contamination(rows, bench)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    clean = decontam.decontaminate(frame(spark, rows), items)
    assert clean.columns == ["doc_id", "text", "key", "lang", "items"]
    assert clean.count() == sum(not r[5] for r in want)
    assert not any(r.contaminated for r in decontam.contamination(frame(spark, rows), items.limit(0)).collect())
    assert decontam.contamination(frame(spark, []), items).isEmpty()


def test_decontamination_with_any_columns(spark):
    names = "doc_id bigint, text string, __bad_id int, bad_id string, bad_key int, id int, row string, w int"
    bench = spark.createDataFrame([(1, "w " * 13)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "w " * 20, 1, "b", 2, 3, "r", 4), (2, "fine", 1, "b", 2, 3, "r", 4), (None, None, None, None, None, None, None, None)], names)
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 2]
    assert decontam.decontaminate(docs.limit(0), bench).isEmpty() and decontam.decontaminate(docs, bench.limit(0)).count() == 3


def test_contamination_of_capital_sigma(spark):
    """A sigma that ends a word before punctuation, and one beside an apostrophe."""
    bench = [(1, " ".join(f"\u0391.\u03a3. \u039f'\u03a3 {i}" for i in range(6))), (2, "\u0391.\u03a3. one"), (3, "two \u0391'\u03a3'\u0391")]
    rows = [(i, f"before it, {t}, and after") for i, t in bench] + [(4, bench[0][1].lower()), (5, bench[0][1])]
    got = decontam.contamination(frame(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute_contamination(rows, bench)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[5] for r in want) == 4


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aaaabbbe  ▁", "éèß日本語한ⅣЯжa ", ".,!?()<>/ 0123\n\t\r", "🎉💥‍﻿ ", "thernndinoug ", "▁ "]


def test_tokenizer_equals_the_library():
    import sentencepiece
    sp, own, rnd = sentencepiece.SentencePieceProcessor(model_file=pieces_model()), spm.tokenizer(pieces_model()), random.Random(0)
    texts = ["", " ", "  ", " a", "a ", "\n", "word " * 3000, "x" * 5000, " " * 500, "日" * 2000]
    for n in range(4000):
        letters = "".join(ALPHABETS) if n % 3 == 0 else ALPHABETS[n % len(ALPHABETS)]
        texts.append("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))))
    for t in texts:
        ids = sp.encode(t)
        n, joined, plain = own.describe(t)
        assert (n, joined, plain) == (len(ids), ",".join(map(str, ids)), sp.decode(ids)), t
        assert own.decode(ids) == plain
    for _ in range(1000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(260), 28705, 259]) for _ in range(rnd.randrange(12))]
        assert own.decode(ids) == sp.decode(ids)


def test_encoded(spark, monkeypatch):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces_model())
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "été"), (1, "Hello  world\n")]
    got = spm.encoded(frame(spark, rows), pieces_model(), with_ids=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids)), ids, sp.decode(ids)) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert spm.encoded(frame(spark, []), pieces_model()).isEmpty()


PAGES = [
    (None, ""), ("", ""), ("plain &lt;text&gt;\n only", "plain <text> only"),
    ("<p>a &amp; b&nbsp; c<br>d", "a & b c d"),
    ("<body><nav><a href=/x>Home</a><a href=/y>News</a></nav><div class='ad'>Buy our things now, they are very good things.</div>"
     "<article><h1>Title</h1><p><b>One two three four five six seven.<br><p>Short.</p></article><footer>&copy; someone</footer></body>",
     "Title\nOne two three four five six seven.\nShort."),
    ("<body><div id=header>Site name</div><div class='post has-sidebar'><h1>T</h1><section><p>Long text here with many words in it.</p>"
     "</section><section><p>Another long text here with many words.</p><p>Hm.</p></section><div class=comments><p>I like this very much indeed,"
     " it is great</p></div></div><div class=sidebar><a href=x>more</a></div></body>",
     "T\nLong text here with many words in it.\nAnother long text here with many words.\nHm."),
    ("<script>var t='</p>';</script><style>p{}</style><main><p>in <i>the</i>main<!-- not --> part</p><form><input>Log in</form></main>", "in themain part"),
    ("<table><tr><td>cell one<td>cell two<tr><td>three</table>", "cell one\ncell two\nthree"),
    ("<p title='a>b'>text</p><p>&#x27;quoted&#39; &unknown; end", "text\n'quoted' &unknown; end"),
    ("<!-- never closed", ""), ("<script>never closed <p>x", ""), ("<div><p>x</div></p></div></section>y", "x\ny"),
]


def test_main_text(spark):
    for page, want in PAGES:
        assert html_text.main_text(page) == want
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert html_text.main_text(deep) == "deep text"
    pages = spark.createDataFrame([(i, None if i == 2 else "u", p, 1) for i, (p, _) in enumerate(PAGES)] + [(None, "u", "<p>x", 1)],
                                  "page_id bigint, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(pages).collect()}
    assert got == {i: (w, len(w)) for i, (_, w) in enumerate(PAGES)} | {None: ("x", 1)}
    assert html_text.extracted(pages.limit(0)).isEmpty()


LONG = "A sentence of the article that goes on for some time, with commas, and ends. " * 4
DOUBTED = [
    # wrappers that name themselves after what they hold or lack, and a page in one form
    (f"<body><div class='layout sidebar-right'><h2>Head</h2><p>{LONG}</p></div></body>", f"Head\n{LONG.strip()}"),
    (f"<body><div class='layout has-sidebar'><h2>Head</h2><p>{LONG}</p></div><div class=sidebar><a href=x>more of it</a></div></body>",
     f"Head\n{LONG.strip()}"),
    (f"<body><form id=f><div id=header>Site</div><h2>Head</h2><p>{LONG}</p><div class=share><a href=x>Share</a></div></form></body>",
     f"Head\n{LONG.strip()}"),
    (f"<body><div class='widget text'><p>{LONG}</p></div><div class='widget text'><p>{LONG}</p></div><div class='widget'><a href=x>a</a></div></body>",
     f"{LONG.strip()}\n{LONG.strip()}"),
    # headings and sections with ids made from their title, inside an article
    (f"<body><article><h1>T</h1><p>{LONG}</p><h2 id=cookies class=section-header>Cookies</h2><section id=social-impact><h2>Social impact</h2><p>Some words.</p>"
     "</section><section id=related-posts><h2>Related posts</h2><a href=x>another page of this site</a></section>"
     "<section id=comments><h2>Comments</h2><p>I like it.</p></section></article></body>",
     f"T\n{LONG.strip()}\nCookies\nSocial impact\nSome words."),
    # an article of a comment does not spare the comments
    (f"<body><div class=post><h1>T</h1><p>{LONG}</p><div class=comments><article><p>{LONG * 2}</p></article></div></div></body>",
     f"T\n{LONG.strip()}"),
]


def test_main_text_in_doubted_elements():
    for page, want in DOUBTED:
        assert html_text.main_text(page) == want
    deep = "<div class=widget>" * 3000 + "deep text" + "</div>" * 3000
    assert html_text.main_text(deep) == "deep text"


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    long = "<p>é\r\n\r\nWARC/1.0\r\n" + "text \n" * 40
    rows = [(4, "http://a/ b", long), (2, None, long), (7, "u", long), (1, "u", "short"), (3, "u", "short"), (5, "u", None), (6, "u", ""),
            (2, "u", long), (None, "u", long), (None, "u", long + "x"), (9, "dns:x", "x" * 99), (10, "u", "x" * 99), (11, "u", "x" * 100),
            (12, "u", "x" * 100), (13, "u", "é" * 50), (14, "u", "é" * 50)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, record_type string")
    got = warc.archive_pages(pages, version).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (i or -1, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got if r.payload_bytes == len(long.encode()))
    assert kinds == sorted([(-1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (4, "revisit", 2), (7, "revisit", 2)], key=str) \
        or sorted(kinds, key=str) == sorted([(-1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (4, "revisit", 2), (7, "revisit", 2)], key=str)
    assert {r.page_id: (r.record_type, r.refers_to) for r in got if r.page_id and r.page_id > 8} == {
        9: ("response", None), 10: ("response", None), 11: ("response", None), 12: ("revisit", 11), 13: ("response", None), 14: ("revisit", 13)}
    assert len({r.record_id for r in got}) == len(rows) and {r.date for r in got} == {"2000-01-01T00:00:00Z"}
    assert warc.archive_pages(pages.limit(0), version).isEmpty()


def test_arc_fields(spark):
    path = warc.write_arc(spark.createDataFrame([(1, "http://x/", "page")], "page_id bigint, url string, html string"), scratch_path(spark, "arc"), 2)
    r = warc.read_arc(spark, path).first()
    assert (r.key, r.url, r.ip, r.date, r.mime, r.payload_bytes) == (1, "http://x/", "0.0.0.0", "20000101000000", "text/html", 4)
    assert warc.warc_date("199610") == "1996-10-01T00:00:00Z" and warc.warc_type("dns:x", b"20000101\nx") == ("response", "text/dns")
    assert warc.warc_type("ftp://x", b"data") == ("resource", None)
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.Stream([b"filedesc://x 0.0.0.0 2000 text/plain 10", b"3 0 x", b"URL", b""])))


def labelled(spark, n=400):
    """Prose in made-up words; label 1 texts hold words of one stem (toxic) or are not junk (quality)."""
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("abcdeilmnorstu") for _ in range(4)) for _ in range(60)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(stems) + rnd.choice(stems)[:3] for _ in range(rnd.randint(20, 200))]
        toxic, junk = rnd.random() < 0.3, rnd.random() < 0.3
        if toxic:
            w = [("vilest" + rnd.choice(stems)[:3]) if rnd.random() < 0.1 else x for x in w]
        if junk:
            w = [x for x in w[:12] for _ in range(9)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "text"), (7, rows[7][1])]
    return rows, labels + [(n + 5, 1, 1), (n, None, None), (None, 1, 1), (7, *labels[7][1:])]


@pytest.mark.parametrize("operator, label", [(toxicity, 2), (quality, 1)], ids=["toxicity", "quality"])
def test_classifiers(spark, operator, label):
    rows, labels = labelled(spark)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = operator.scores(frame(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: row[label - 1] for i, *row in labels if i is not None and row[0] is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.9
    # Held-out labels do not matter, and the order of rows does not either.
    other = [(i, *((None if v is None else 1 - v) for v in x)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else (i, *x) for i, *x in labels]
    again = operator.scores(frame(spark, rows[::-1]), spark.createDataFrame(other[::-1], "doc_id bigint, quality int, toxic int")).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in got) == sorted((r.doc_id or -1, round(r.score, 6)) for r in again)
    assert max(r.score for r in operator.scores(frame(spark, rows), table.limit(0)).collect()) < 1e-6
    assert operator.scores(frame(spark, []), table).isEmpty()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rnd = random.Random(11)
    rows, labels = labelled(spark)
    rows = [(i, t) for i, t in rows if t]
    item = " ".join(f"item{i}" for i in range(20))
    unique = " ".join(f"u{rnd.random()}" for _ in range(300))
    rows += [(1000, "Some fine text"), (1001, "some FINE text"), (1002, "before " + item + " after"), (1003, unique), (1004, unique.replace(" ", "  ", 1))]
    for name, df in (("documents", spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")),
                     ("labels", spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")),
                     ("benchmark", spark.createDataFrame([(1, item)], "item_id bigint, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 1001 in ids and not ids & {1000, 1002, 1004} and 1003 in ids
    toxic = {i for i, _, y in labels if y}
    clean = {i for i, _, y in labels if y == 0 and i is not None and i < 400}
    assert len(ids & toxic) < 0.1 * len(toxic) and len(clean - ids) < 0.1 * len(clean)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.isEmpty()
