"""HTML columns: title, visible text and link targets by regular expression.

One alternation finds comments, elements without visible text and tags from left to right, so a
page is cut into its text nodes in a single pass that stays in the JVM.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawlight.functions.text import strip

# Markup that shows no text of its own, up to the end of the page when unclosed.
HIDDEN = (
    r"<!--.*?-->"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
)
HIDDEN_TEMPLATE = r"<template\b.*?(?:</template\s*>|\z)"

# A tag; a quoted attribute value may contain an angle bracket, and one that is never closed makes
# its tag plain text. The quantifiers are possessive, so a page that ends inside a tag costs one pass and not
# a search of all splits.
_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|(?!["']))[^>=]*+)*+>"""
TAG = rf"<[a-z/!?]{_ATTRIBUTES}"

# The start tag of a link, and its target in any of the three quoting styles.
LINK_TAG = rf"(?is)<a\s{_ATTRIBUTES}"
_OTHER_ATTRIBUTE = r"""[^\s=>"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))?+\s*+"""
HREF = rf"""(?is)^<a\s+(?:{_OTHER_ATTRIBUTE})*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""

TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"

# A character reference; the closing semicolon may be missing.
REFERENCE = r"(&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);?)"
_MARK = "\ufdd0"  # a code point that no text may contain
_REPLACEMENT = "\ufffd"

_NAMED = json.dumps(html5)
# Names that stand without a semicolon, the longest match first.
_OPEN_NAMES = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name)))
# Numbers 128 to 159 mean Windows-1252, where that defines them.
_WINDOWS = [bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(128, 160)]
_TOO_HIGH = 0x110000


def _number(digits: Column, base: int, most: int) -> Column:
    """The value of digits without leading zeros; more than ``most`` of them are no code point."""
    value = F.coalesce(F.conv(digits, base, 10).try_cast("bigint"), F.lit(0))
    return F.when(F.length(digits) > most, F.lit(_TOO_HIGH)).otherwise(value)


def _character(code: Column) -> Column:
    """The character of a code point; control and non-characters vanish, what is no code point is replaced."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    unseen = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    windows = F.get(F.array(*[F.lit(character) for character in _WINDOWS]), (code - 128).cast("int"))
    return (
        F.when(~valid, _REPLACEMENT)
        .when(code.between(128, 159), windows)
        .when(unseen, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _resolve_reference(piece: Column) -> Column:
    body = F.substring(piece, 2, 1 << 30)
    names = F.from_json(F.lit(_NAMED), "map<string,string>")
    known = F.try_element_at(names, body)
    start = F.regexp_extract(body, f"^({_OPEN_NAMES})", 1)
    opened = F.concat(F.try_element_at(names, F.nullif(start, F.lit(""))), F.substr(body, F.length(start) + 1))
    decimal = _character(_number(F.regexp_extract(body, "^#0*([0-9]*)", 1), 10, 7))
    hexadecimal = _character(_number(F.regexp_extract(body, "^#[xX]0*([0-9a-fA-F]*)", 1), 16, 6))
    return (
        F.when(~piece.startswith("&"), piece)
        .when(body.rlike("^#[xX][0-9a-fA-F]"), hexadecimal)
        .when(body.rlike("^#[0-9]"), decimal)
        .otherwise(F.coalesce(known, opened, piece))
    )


def decode_references(text: Column) -> Column:
    """Replace character references; unknown names stay as they are."""
    pieces = F.split(F.regexp_replace(text, REFERENCE, f"{_MARK}$1{_MARK}"), _MARK)
    decoded = F.array_join(F.transform(pieces, _resolve_reference), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def html_title(html: Column) -> Column:
    """The first title, stripped; a missing title, or one with markup inside, is empty."""
    inner = F.regexp_extract(F.regexp_replace(html, f"(?is){HIDDEN}", " "), TITLE, 1)
    return F.when(inner.rlike("<[A-Za-z/!?]"), F.lit("")).otherwise(strip(decode_references(inner)))


def html_text(html: Column) -> Column:
    """All visible text nodes, each stripped, joined by one blank; the title is one of them."""
    nodes = F.split(html, f"(?is){HIDDEN}|{HIDDEN_TEMPLATE}|{TAG}")
    stripped = F.transform(nodes, lambda node: strip(decode_references(node)))
    return F.array_join(F.array_remove(stripped, ""), " ")


def html_hrefs(html: Column) -> Column:
    """Non-empty link targets in document order, as written on the page."""
    tags = F.regexp_extract_all(F.regexp_replace(html, f"(?is){HIDDEN}", " "), F.lit(LINK_TAG), F.lit(0))
    hrefs = F.transform(
        tags,
        lambda tag: decode_references(F.concat(*[F.regexp_extract(tag, HREF, group) for group in (1, 2, 3)])),
    )
    return F.array_remove(hrefs, "")
