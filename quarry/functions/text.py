"""Column expressions for text: strip, line breaks, tokens, counts of substrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: every character that Unicode-aware stripping takes off, as a class for Java's regex and RE2.
BLANKS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP = rf"\A{BLANKS}+|{BLANKS}+\z"
#: The same characters as text.
BLANK_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TOKEN = "[a-z0-9]+"
#: Fixed value: where splitting into lines cuts.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: The same without what the text reader cuts at.
OTHER_BREAK = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row wherever body uses it, and the whole in one piece also as a filter."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def newlines(text: Column) -> Column:
    """Line ends as text mode reads them."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a substring that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def has_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def before(text: Column, marker: str) -> Column:
    """What stands before the first marker; all of it if there is none."""
    return F.substring_index(text, marker, 1)


def after(text: Column, marker: str) -> Column:
    """What stands after the first marker; empty if there is none."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise("")
