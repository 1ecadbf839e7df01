"""String expressions: ranking text, tokens, extractive summary, score text.

All are plain Column -> Column builders that stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitweave.functions.stopwords import listed

# White space as str.strip() and str.split() see it (Java's and RE2's \s are ASCII).
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

DEFAULT_STOP_WORDS = "english"  # removed before TF-IDF; a parameter of every TF-IDF job

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"  # words of two or more letters/digits/underscore
SENTENCE_SPLIT = r"[.!?]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(col) -> Column:
    """Trim all leading/trailing whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


def ranking_text(title, snippet) -> Column:
    """``"title snippet"`` lower-cased and trimmed; a missing side counts as ''."""
    return strip_ws(F.lower(F.concat_ws(" ", F.coalesce(_c(title), F.lit("")),
                                        F.coalesce(_c(snippet), F.lit("")))))


def tokens(text, stop_words=DEFAULT_STOP_WORDS) -> Column:
    """Lower-cased word tokens of >= 2 word characters, stop words removed."""
    return F.filter(raw_tokens(text), lambda t: ~is_stop_word(t, stop_words))


def raw_tokens(text) -> Column:
    """Lower-cased word tokens, stop words kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def is_stop_word(term, stop_words=DEFAULT_STOP_WORDS) -> Column:
    """Membership test for tokens (an ``InSet``, stays in codegen)."""
    words = listed(stop_words)
    return _c(term).isin(*words) if words else F.lit(False)


def query_words(query) -> Column:
    """Whitespace-separated words of a query (no empty pieces)."""
    return F.filter(F.split(F.coalesce(_c(query), F.lit("")), f"{WS}+", -1), lambda t: t != "")


def extractive_summary(query, context, max_sentences: int = 2, min_chars: int = 20,
                       fallback_chars: int = 200) -> Column:
    """Sentences of ``context`` containing any word of ``query`` (case-insensitive
    substring), first two joined by a space; if none, or the join has at most
    ``min_chars`` characters: the first ``fallback_chars`` characters + '...'."""
    ctx = F.coalesce(_c(context), F.lit(""))
    words = query_words(query)
    sents = F.split(ctx, SENTENCE_SPLIT, -1)
    hits = F.filter(sents, lambda s: F.exists(words, lambda w: F.lower(s).contains(F.lower(w))))
    joined = F.array_join(F.transform(F.slice(hits, 1, max_sentences), strip_ws), " ")
    fallback = F.concat(F.substring(ctx, 1, fallback_chars), F.lit("..."))
    return F.when((F.size(hits) > 0) & (F.length(joined) > min_chars), joined).otherwise(fallback)


def round_binary(col, digits: int = 2) -> Column:
    """Round a double to ``digits`` decimals by its exact binary value, half to
    even on exact ties (what C, Python and JavaScript formatting do).

    ``x * 10^d`` is computed error-free (Dekker's product with a Veltkamp split:
    ``p + e`` is the exact product), so a product that rounds onto .5 is still
    decided by the true value.  Pure double arithmetic: stays in codegen."""
    x = _c(col).cast("double")
    scale = float(10 ** digits)
    p = x * F.lit(scale)
    c = x * F.lit(134217729.0)                    # 2^27 + 1
    hi = c - (c - x)
    lo = x - hi
    e = (hi * F.lit(scale) - p) + lo * F.lit(scale)   # scale splits exactly (< 2^27)
    n = F.floor(p).cast("double")
    frac = p - n
    up = (frac > 0.5) | ((frac == 0.5) & ((e > 0) | ((e == 0) & (F.pmod(n, F.lit(2.0)) == 1.0))))
    return (F.when(up, n + 1.0).otherwise(n)) / F.lit(scale)


def score_text(col) -> Column:
    """Two-decimal score text as the result page shows (and sends back);
    0.145 (stored as 0.14499..) -> "0.14", 0.225 (0.22500..06) -> "0.23"."""
    return F.format_string("%.2f", round_binary(col, 2))
