"""Text columns: trimming, tokenising, snippets."""

from __future__ import annotations

import unicodedata
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that str.strip() removes.
STRIP_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Tokens are runs of letters, numbers and private-use characters.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}\p{Co}]+"

SNIPPET_LENGTH = 200

# Letters that keep their marks although the fold rule covers them.
_UNFOLDED = {"Ǡ", "ǡ"}


def _fold_pairs() -> tuple[str, str]:
    """Arguments of ``translate``, by rule.

    A marked letter over an ASCII base loses its marks; the same marks standing alone have no
    counterpart and are therefore deleted. Letters whose case folding differs from plain lower
    case (a final sigma, the long s, Greek symbol forms) go to their folded form.
    """
    pairs = {"Σ": "σ"}
    dropped = set()
    for code in range(0xB5, 0x3000):
        letter = chr(code)
        folded = letter.casefold() if len(letter.casefold()) == 1 else letter
        base, *marks = unicodedata.normalize("NFD", folded)
        if marks and base.isascii() and base.isalpha() and letter not in _UNFOLDED:
            pairs[letter] = base.lower()
            dropped.update(marks)
        elif folded not in (letter, letter.lower()):
            pairs[letter] = folded
    return "".join(pairs) + "".join(sorted(dropped)), "".join(pairs.values())


_FOLD_FROM, _FOLD_TO = _fold_pairs()


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.trim(text, F.lit(STRIP_CHARACTERS))


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics; plain ASCII takes the short way."""
    folded = F.translate(text, _FOLD_FROM, _FOLD_TO)
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text))


def tokens(text: Column) -> Column:
    """The tokens of a text in order; NULL gives no tokens."""
    pieces = F.split(fold(F.coalesce(text, F.lit(""))), TOKEN_SEPARATOR)
    return F.array_remove(pieces, "")


def snippet(text: Column, length: int = SNIPPET_LENGTH) -> Column:
    """The head of a text, marked with dots when something was cut off."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def query_tokens(text: str) -> list[str]:
    """Tokens of a search argument, by the rules of :func:`tokens`."""
    kept = dict(zip(_FOLD_FROM, _FOLD_TO)) | {mark: "" for mark in _FOLD_FROM[len(_FOLD_TO) :]}
    folded = "".join(kept.get(character, character) for character in text).lower()

    def is_token(character: str) -> bool:
        category = unicodedata.category(character)
        return category[0] in "LN" or category == "Co"

    return ["".join(run) for inside, run in groupby(folded, is_token) if inside]
