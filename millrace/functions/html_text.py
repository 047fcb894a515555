"""Character references of HTML, decoded natively: all named ones and numbers, in one pass over a text."""

from __future__ import annotations

from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that count without a semicolon too, also where more follows.
OPEN = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
#: What numbers from 128 to 159 stand for: characters of the old Windows code page, where it has one.
OLD = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]
_NAME, _IS = "\ue000", "\ue001"
#: All names with what they stand for, in short texts by the names' CRC-32: a mark, a name, a mark, its characters.
TABLES = [_NAME] * 1024
for _n, _v in html5.items():
    TABLES[crc32(_n.encode()) % len(TABLES)] += f"{_n}{_IS}{_v}{_NAME}"


def once(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def _stands_for(name: Column) -> Column:
    """What a name stands for; null if there is no such name."""
    entry = F.concat(F.lit(_NAME), name, F.lit(_IS))
    table = F.get(F.array(*map(F.lit, TABLES)), (F.crc32(F.encode(name, "UTF-8")) % len(TABLES)).cast("int"))
    found = lambda t: once(F.instr(t, entry), lambda at: F.when(at > 0, F.substring_index(F.substring(t, at + F.length(name) + 2, F.lit(8)), _NAME, 1)))
    return once(table, found)


def _number(ref: Column) -> Column:
    hexadecimal = F.substring(ref, 3, 1).isin("x", "X")
    digits = F.regexp_replace(F.regexp_replace(ref, "^&#[xX]?0*", ""), ";$", "")
    n = F.coalesce(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0))
    n = F.when(F.length(digits) > 7, F.lit(1 << 30)).otherwise(n)
    text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    wrong = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    old = F.element_at(F.array(*map(F.lit, OLD)), (n - 127).cast("int"))
    return F.when(wrong, "�").when(n.between(128, 159), old).when(none, "").otherwise(text)


def _name(ref: Column) -> Column:
    # the longest name that a reference begins with, if it has none of its own
    start = lambda name: F.regexp_extract(name, "^(?:" + "|".join(OPEN) + ")", 0)
    begun = lambda name: once(start(name), lambda s: F.when(s != "", F.concat(_stands_for(s), F.substring(name, F.length(s) + 1, F.lit(40)))))
    return once(F.substring(ref, 2, 40), lambda name: F.coalesce(_stands_for(name), begun(name), ref))


def unescape(text: Column) -> Column:
    """text with its character references decoded, as browsers read them; what they give is not read again."""

    def decoded(t: Column) -> Column:
        said = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), 0), lambda r: F.when(F.substring(r, 2, 1) == "#", _number(r)).otherwise(_name(r)))
        return F.array_join(F.flatten(F.zip_with(F.split(t, REFERENCE, -1), said, lambda b, s: F.array(b, F.coalesce(s, F.lit(""))))), "")

    return once(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))
