"""Small text helpers that keep Unicode text semantics stable on the JVM side.

Java's ``\\s``, ``\\d`` and ``\\b`` are ASCII-only by default and even under ``(?U)`` differ in
a few control characters, so the patterns of this package are written with the explicit classes
below.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators, as a class and as plain characters.
SPACE_CHARS = r"\p{IsWhite_Space}\x1c-\x1f"
_SPACES = "".join(
    chr(code) for code in range(0x10000) if chr(code).isspace()
)
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
DIGIT = r"\p{Nd}"
# Word boundary before / after a word character.
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

OTHER_LINE_BREAKS = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
AFTER_LINE_BREAK = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"

QUOTES = "`\"'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` only knows the blank)."""
    return F.btrim(c, F.lit(_SPACES))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """True when one of the plain texts occurs; much cheaper than an alternation."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def explode_found(array: Column) -> Column:
    """``explode_outer``, to be followed by a not-null filter on the result.

    A plain ``explode`` makes Spark infer a filter on the size of the array; pushed below the
    projection that computes the array, that filter computes it a second time.
    """
    return F.explode_outer(array)


def lines_keeping_breaks(c: Column) -> Column:
    """Lines including their terminators, so that joining them restores the text."""
    parts = F.when(c.rlike(OTHER_LINE_BREAKS), F.split(c, AFTER_LINE_BREAK, -1)).otherwise(
        F.split(c, r"(?<=\n)", -1)
    )
    return F.filter(parts, lambda s: s != "")


def lines(c: Column) -> Column:
    """Lines without terminators; a final terminator does not open another line."""

    def drop_empty_tail(parts: Column) -> Column:
        n = F.size(parts)
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)

    # splitting on a single character does not need the regex engine
    parts = F.when(c.rlike(OTHER_LINE_BREAKS), F.split(c, LINE_BREAK, -1)).otherwise(
        F.split(c, "\n", -1)
    )
    return let(parts, drop_empty_tail)


@cache
def _foreign_digits() -> tuple[str, str]:
    """All decimal digits outside ASCII and the ASCII digit each one stands for."""
    chars = [
        chr(code) for code in range(0x80, 0x110000) if unicodedata.category(chr(code)) == "Nd"
    ]
    return "".join(chars), "".join(str(unicodedata.decimal(ch)) for ch in chars)


def ascii_digits(c: Column) -> Column:
    """Rewrite decimal digits of any script as ASCII digits."""
    source, target = _foreign_digits()
    return F.translate(c, source, target)
