"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a word the table holds the one token that the encoding of that prefix ends
with.  An Aho-Corasick automaton over the vocabulary names the tokens that end at a position; the
one that belongs in the table is the one that may follow the table's token for what precedes it.
Two tokens may stand side by side if undoing their merges, latest first, never shows a pair that
BPE would have merged sooner.  The ids are then read from the table backwards.  No merge loop runs
on the text, and the cost is linear in its length.

Pieces hold the white-space mark only in front (or are runs of it), and characters outside the
vocabulary never merge, so a text is encoded word by word.  Frequent words are remembered, up to a
fixed number.  Runs of white space, whose pieces all have the same score, are merged left to right
by the library's rule and remembered by their length.

Defined results: null and empty texts have no ids and decode to the empty text.  Repeated rows and
extra columns do not matter: each row is encoded by itself.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import mapped

MARK = "▁"  # fixed value: the white-space mark
REMEMBERED = 300_000  # words, in each of two generations
PAIRS = 500_000  # compatibility answers
_START = 1 << 19  # in place of a token, where a span begins
LONG_WORD = 256  # characters; longer words are encoded but not remembered


class Words(dict):
    """What ``make`` makes of a word, remembered.  When full, the words become the old
    generation, from which those still in use come back."""

    def __init__(self, make):
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, word):
        found = self._old.get(word) or self._make(word)
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self._old = dict(self)
                self.clear()
            self[word] = found
        return found


class Odd(str):
    """Ids of a word that decode to another ``text``."""

    def __new__(cls, ids: str, text: str):
        odd = super().__new__(cls, ids)
        odd.text = text
        return odd


class Tokenizer:
    """Vocabulary of a SentencePiece BPE model file; the library only reads the file."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.control = {i for i in range(sp.vocab_size()) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        special = self.control | {self.unknown} | set(self.byte_of)
        usable = [i for i in range(len(self.pieces)) if i not in special]
        self.id_of = {self.pieces[i]: i for i in usable}
        score = {i: sp.get_score(i) for i in usable}
        self.runs = {len(p): i for p, i in self.id_of.items() if set(p) == {MARK}}
        if any(MARK in p[1:] for p in self.id_of if set(p) != {MARK}):
            raise ValueError("pieces with white space inside are not supported")
        # Merges in the order BPE makes them; characters come first.
        merged = sorted((i for i in usable if len(self.pieces[i]) > 1 and i not in self.runs.values()), key=lambda i: -score[i])
        self.rank = {i: -1 for p, i in self.id_of.items() if len(p) == 1}
        self.rank.update({i: r for r, i in enumerate(merged)})
        self.parts = {}
        for i in merged:
            if parts := self._last_merge(self.pieces[i]):
                self.parts[i] = parts
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) == 1 or i in self.parts:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self._chars = frozenset(p for p in self.id_of if len(p) == 1)
        self._size = [len(p) for p in self.pieces]
        self._digits = [str(i) for i in range(len(self.pieces))]
        self._inside = {p[i:i + 2] for p in self.id_of for i in range(len(p) - 1)}  # neighbours in any piece
        self._allowed: dict[int, bool] = {}
        self._run_ids: dict[int, str] = {}
        self._mark = str(self.runs[1])
        self.words, self.spans = Words(self._word), Words(self._ids)

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens BPE last merges to make ``piece``; None if it never makes it."""
        tokens = [self.id_of.get(c) for c in piece]
        if None in tokens:
            return None
        while True:
            pairs = [(self.rank.get(self.id_of.get(self.pieces[a] + self.pieces[b], -1), 1 << 40), i)
                     for i, (a, b) in enumerate(zip(tokens, tokens[1:]))]
            rank, i = min(pairs)
            if rank == 1 << 40:
                return None
            if len(tokens) == 2:
                return tokens[0], tokens[1]
            tokens[i:i + 2] = [self.id_of[self.pieces[tokens[i]] + self.pieces[tokens[i + 1]]]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' text leaves just these two."""
        rank, pieces, id_of = self.rank, self.pieces, self.id_of
        limit = 1 << 40  # merges of this rank or later had not happened yet
        while True:
            joined = id_of.get(pieces[left] + pieces[right])
            if joined is not None and rank.get(joined, limit) < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:  # the left token was merged last; on equal ranks BPE merges left to right
                limit, left = a, self.parts[left][1]
            elif b >= 0:
                limit, right = b + 1, self.parts[right][0]
            else:
                return True

    def _known(self, span: str) -> list[int]:
        """Ids of a span without characters outside the vocabulary."""
        last: list[int] = [-1] * (len(span) + 1)
        last[0] = _START
        allowed, found = self._allowed, -1
        for end, (token, size) in self.automaton.iter(span):  # the longest token first
            if end == found:
                continue
            before = last[end + 1 - size]
            ok = allowed.get(before << 20 | token)
            if ok is None:
                if len(allowed) >= PAIRS:
                    allowed.clear()
                ok = allowed[before << 20 | token] = before == _START or self.may_follow(before, token)
            if ok:
                last[end + 1], found = token, end
        ids, at, sizes = [], len(span), self._size
        while at:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def _run(self, n: int) -> str:
        """Ids of ``n`` white-space marks, joined by commas: neighbours are merged leftmost first while a piece of
        their length exists."""
        if n not in self._run_ids:
            if len(self._run_ids) > 1000:
                self._run_ids.clear()
            size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = [(i, 1, 1) for i in range(n - 1)] if 2 in self.runs else []
            while agenda:
                i, a, b = heapq.heappop(agenda)
                j = nxt[i]
                if size[i] != a or j >= n or size[j] != b:
                    continue
                size[i], size[j], nxt[i] = a + b, 0, nxt[j]
                if nxt[i] < n:
                    prev[nxt[i]] = i
                    if size[i] + size[nxt[i]] in self.runs:
                        heapq.heappush(agenda, (i, size[i], size[nxt[i]]))
                if prev[i] >= 0 and size[prev[i]] + size[i] in self.runs:
                    heapq.heappush(agenda, (prev[i], size[prev[i]], size[i]))
            self._run_ids[n] = ",".join([str(self.runs[s]) for s in size if s])
        return self._run_ids[n]

    def _ids(self, span: str) -> str:
        """Ids, joined by commas, of a span that no merge leaves: a known span, or one character that is not."""
        ids = self._known(span) if span[0] in self._chars else [self.byte_id[b] for b in span.encode()]
        return ",".join([self._digits[i] for i in ids])

    def _span(self, marked: str) -> str:
        """Ids of one word, its mark in front.  It is cut between characters that stand side by
        side in no piece (a letter and a comma, say): no merge crosses there."""
        inside = self._inside
        if inside.issuperset(map(add, marked, marked[1:])):
            return self.spans[marked]
        at, ids = 0, []
        for i in range(1, len(marked)):
            if marked[i - 1:i + 1] not in inside:
                ids.append(self.spans[marked[at:i]])
                at = i
        ids.append(self.spans[marked[at:]])
        return ",".join(ids)

    def _word(self, word: str) -> str:
        """Ids of a word, joined by commas; ``Odd`` if they do not decode to the word.  (Pieces of characters of the
        vocabulary are the word, cut; others go through bytes, which are decoded here.)"""
        ids = self._span(MARK + word)
        if self._chars.issuperset(word):
            return ids
        text = self.decode(list(map(int, ids.split(","))), keep_space=True)
        return ids if text == " " + word else Odd(ids, text)

    def encode(self, text: str) -> list[int]:
        n, ids, _ = self.describe(text)
        return list(map(int, ids.split(","))) if n else []

    def describe(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text they decode to.

        What a word's ids decode to was found when the word was first met; where that is the word itself for all
        words of a text, the ids decode to the text."""
        if not text:
            return 0, "", ""
        spaced = text.replace(MARK, " ")  # one mark is put in front of the text, as the library does
        words = spaced.split(" ")
        if "" not in words:
            found = list(map(self.words.__getitem__, words))
            odd = {*map(type, found)} != {str}
            plain = "".join([f.text if type(f) is Odd else " " + w for f, w in zip(found, words)])[1:] if odd else spaced
        else:
            found, texts, spaces = [], [], 0
            for w in words:
                spaces += 1
                if w:
                    ids = self.words[w]
                    text_of = ids.text if type(ids) is Odd else " " + w
                    if spaces > 1:
                        first, _, rest = ids.partition(",")
                        alone = first == self._mark  # the word's own mark stayed single
                        n = spaces - (not alone)
                        found.append(self._run(n))
                        texts.append(" " * n)
                        ids, text_of = (rest, text_of[1:]) if alone else (ids, text_of)
                    if ids:
                        found.append(ids)
                    texts.append(text_of)
                    spaces = 0
            if spaces:
                found.append(self._run(spaces))
                texts.append(" " * spaces)
            plain = "".join(texts)[1:]
        ids = ",".join(found)
        return ids.count(",") + 1, ids, plain

    def decode(self, ids: list[int], keep_space: bool = False) -> str:
        """Text of ids: the mark is a space, one leading space is dropped, runs of byte pieces
        are UTF-8 (wrong bytes become U+FFFD), control pieces are nothing."""
        out, raw, first = [], bytearray(), not keep_space
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                first = False
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i in self.control:
                continue
            piece = " ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " ")
            out.append(piece[1:] if first and i != self.unknown and piece.startswith(" ") else piece)
            first = False
        return "".join(out) + (_utf8(bytes(raw)) if raw else "")


def _utf8(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(model: str) -> Tokenizer:
    """The tokenizer of a model file, built once in a process."""
    if model not in _LOADED:
        _LOADED[model] = Tokenizer(model)
    return _LOADED[model]


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with
    ``with_ids`` also ``ids`` (array<int>) and ``decoded``."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(model)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts, ids, decoded, digests, plain = [], [], [], [], []
                for x in part.column(1):
                    n, i, d = t.describe(x.as_py())
                    counts.append(n)
                    digests.append(digest(i))
                    decoded.append(digest(d))
                    if with_ids:
                        ids.append(np.fromstring(i, np.int32, sep=",") if n else np.zeros(0, np.int32))
                        plain.append(d)
                columns = {"doc_id": part.column(0), "n_tokens": pa.array(counts, pa.int64()),
                           "ids_sha256": pa.array(digests), "decoded_sha256": pa.array(decoded)}
                if with_ids:
                    columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(plain)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(
        mapped, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
