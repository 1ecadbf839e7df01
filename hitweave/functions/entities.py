"""HTML character references decoded as one native expression.

The text is cut at ``&``.  What follows a cut begins with a numeric reference, a name that is looked
up with and without its semicolon, or neither; the longest name of the old ones, which need no
semicolon, also counts inside a longer word (``&notit;`` is ``¬it;``).  Each piece is decoded by
itself, so a reference that decoding brings out is not decoded again.

The table of names is the standard library's (HTML5, 2,231 names); Spark folds it into one constant map.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0c <&#;]{1,32};?)"  # a number, or what may be a name
MAX_CODE = 0x10FFFF
LOST = "�"

_END, _IS = "\x01", "\x02"  # in no name and no value


def code_exceptions() -> dict[int, str]:
    """Numbers that do not stand for the character with that number: 0 and the bytes 128 to 159,
    which are read as Windows-1252 where that has a character."""
    out = {0: LOST}
    for n in range(0x80, 0xA0):
        out[n] = bytes([n]).decode("cp1252", "ignore") or chr(n)
    return out


@cache
def _table(old: bool) -> str:
    """Names to characters as text: all of them, or those that need no semicolon."""
    return _END.join(f"{name}{_IS}{value}" for name, value in sorted(html5.items()) if not (old and name.endswith(";")))


@cache
def _old_names() -> str:
    """Pattern of the names that need no semicolon, longest first."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^(?:" + "|".join(names) + ")"


def _map(text: str) -> Column:
    return F.str_to_map(F.lit(text), F.lit(_END), F.lit(_IS))


def character(code: Column) -> Column:
    """The character a numeric reference stands for; ``code`` is a bigint, -1 if out of range.  Surrogates and numbers
    beyond Unicode are lost, control characters and noncharacters are nothing."""
    low = code.bitwiseAND(F.lit(0xFFFF))
    nothing = (code.between(0x1, 0x8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F)
               | code.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE))
    special = _map(_END.join(f"{n}{_IS}{c}" for n, c in code_exceptions().items()))
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when((code < 0) | (code > MAX_CODE) | code.between(0xD800, 0xDFFF), F.lit(LOST))
            .when((code == 0) | code.between(0x80, 0x9F), F.try_element_at(special, code.cast("string")))
            .when(nothing, F.lit("")).otherwise(plain))


def _code(number: Column) -> Column:
    """Value of a numeric reference without ``&``, -1 when it is too large to be a character."""
    hexadecimal = F.rlike(number, F.lit("^#[xX]"))
    digits = F.regexp_replace(number, "^#[xX]?0*(?=[0-9a-fA-F])|;", "")
    value = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    return F.when(F.length(digits) > 7, F.lit("-1")).otherwise(value).cast("bigint")


def _piece(after: Column) -> Column:
    """What stands for ``&`` and the text after it."""
    found = F.regexp_extract(after, REFERENCE, 0)
    rest = lambda part: F.substr(after, F.length(part) + 1)
    untouched = F.concat(F.lit("&"), after)

    def old(name: Column) -> Column:
        short = F.regexp_extract(name, _old_names(), 0)
        return F.when(short == "", untouched).otherwise(F.concat(F.try_element_at(_map(_table(True)), short), rest(short)))

    def numbered(reference: Column) -> Column:
        decoded = F.transform(F.array(_code(reference)), character)
        return F.concat(F.get(decoded, 0), rest(reference))

    def named(name: Column) -> Column:
        whole = F.transform(F.array(F.try_element_at(_map(_table(False)), name)),
                            lambda c: F.when(c.isNull(), old(name)).otherwise(F.concat(c, rest(name))))
        return F.get(whole, 0)

    one = F.transform(F.array(found), lambda r: F.when(r == "", untouched).when(F.startswith(r, F.lit("#")), numbered(r)).otherwise(named(r)))
    return F.get(one, 0)


def html_unescape(text: Column) -> Column:
    """``text`` with its character references decoded, once."""
    pieces = F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(_piece(p)))
    return F.array_join(pieces, "")
