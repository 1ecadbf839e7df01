"""HTML and URL expressions: host, visible text, word/link counts, meta dates.

A page is read as a sequence of tokens by one ordered pattern, so that each place belongs to
one token only: a comment hides the tags in it, a script its strings, a quoted attribute value its
``>``.  Comments, scripts, styles and templates that are never closed reach to the end of the page.
Everything stays in codegen and runs where the pages are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitweave.functions.entities import html_unescape

# Fixed pattern: scheme and authority of a URL.
URL_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"

# What follows a tag's name: anything but ``>``, where a value after ``=`` may be quoted.  (Possessive:
# an unclosed quote is a plain character, and no page makes the matcher go back over a tag.)
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+|["'])*+"""


def _either_case(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in name)


def _hidden(name: str) -> str:
    """The rest of a hidden element, after ``<`` and to its end tag or the end of the page."""
    name = _either_case(name)
    return rf"{name}(?:[\s/]{_ATTRIBUTES})?>.*?(?:</{name}(?:[\s/][^>]*+)?>|\z)"


TOKEN = (rf"(?s)<(?:!--.*?(?:--!?>|\z)|{_hidden('script')}|{_hidden('style')}|{_hidden('template')}"
         rf"|[!?][^>]*+>|/?[a-zA-Z]{_ATTRIBUTES}>|/[^a-zA-Z>][^>]*+>|/>)")
TAG_NAME = r"^<[^\s/>]*"
ATTRIBUTE = r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?"""
# What names a publication date in a <meta>.
DATE_PROPERTIES = ("article:published_time", "og:published_time")
DATE_NAMES = ("date", "publish-date", "article.published")
# A run of white space as str.split() sees it.  (The few rare ones are behind a range, which letters do not pass.)
WS_RUN = (r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
          r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]+")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_host(url) -> Column:
    """Network location of a URL as written (keeps port, userinfo, case); neither scheme nor //: ''."""
    return F.coalesce(F.regexp_extract(_c(url), URL_AUTHORITY, 1), F.lit(""))


def host_suffixes(host) -> Column:
    """``a.b.com`` -> [a.b.com, b.com, com]: lets suffix matching be an equi-join."""
    parts = F.split(_c(host), r"\.", -1)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, i, n), "."))


def tokens(html) -> Column:
    """Comments, declarations, tags and hidden elements of a page, in order."""
    return F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(TOKEN), F.lit(0))


def tags(html, name: str) -> Column:
    """The start tags of ``name`` outside comments and hidden elements."""
    return F.filter(tokens(html), lambda t: t.rlike(rf"(?i)^<{name}[\s/>]"))


def _attribute_parts(tag: Column, i: int) -> Column:
    return F.regexp_extract_all(F.regexp_replace(tag, TAG_NAME, ""), F.lit(ATTRIBUTE), F.lit(i))


def attribute_names(tag: Column) -> Column:
    """Names of a tag's attributes in order, in lower case."""
    return F.transform(_attribute_parts(tag, 1), lambda n: F.lower(n))


def attributes(tag: Column) -> Column:
    """``name, value`` of a tag's attributes in order; values decoded, '' without a value."""
    both = lambda a, b: F.concat(a, b)
    value = F.zip_with(F.zip_with(_attribute_parts(tag, 2), _attribute_parts(tag, 3), both), _attribute_parts(tag, 4), both)
    return F.zip_with(attribute_names(tag), value, lambda n, v: F.struct(n.alias("name"), html_unescape(v).alias("value")))


def visible_text(html) -> Column:
    """Text of the page: tokens removed, character references decoded, white-space runs collapsed to one space, trimmed."""
    text = F.regexp_replace(F.coalesce(_c(html), F.lit("")), TOKEN, " ")
    return F.trim(F.regexp_replace(html_unescape(text), WS_RUN, " "))


def word_count(visible) -> Column:
    """Number of words of a visible text (its words are separated by one space)."""
    text = _c(visible)
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def link_count(html) -> Column:
    """Number of ``<a>`` tags carrying an ``href`` (outside comments and hidden elements)."""
    return F.size(F.filter(tags(html, "a"), lambda t: F.array_contains(attribute_names(t), "href"))).cast("bigint")


def content_score(words, links) -> Column:
    """Words per link, the quality floor's measure."""
    return _c(words).cast("double") / F.greatest(_c(links), F.lit(1)).cast("double")


def _value(found: Column, name: str) -> Column:
    """Value of the first attribute of a name, null without one."""
    return F.try_element_at(F.filter(found, lambda a: a["name"] == name), F.lit(1))["value"]


def meta_published_date(html) -> Column:
    """``content`` of the first <meta> naming a publication date; null if none or empty."""
    found = F.transform(tags(html, "meta"), attributes)
    dated = F.filter(found, lambda a: F.coalesce(_value(a, "property").isin(*DATE_PROPERTIES), F.lit(False))
                     | F.coalesce(_value(a, "name").isin(*DATE_NAMES), F.lit(False)))
    return F.nullif(_value(F.try_element_at(dated, F.lit(1)), "content"), F.lit(""))
