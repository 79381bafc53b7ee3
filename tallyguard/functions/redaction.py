"""Secret patterns and the redaction cascade as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyguard.functions.text import (
    DIGIT,
    NON_SPACE,
    SPACE,
    WORD_START,
    let,
    lines_keeping_breaks,
)


@dataclass(frozen=True)
class Anchor:
    """A cheap necessary condition of a pattern: a text without it cannot match.

    Substring tests cost a tenth of a regular expression, and nearly all text fails them.
    """

    words: tuple[str, ...] = ()
    ignore_case: bool = False
    regex: str | None = None

    def holds(self, text: Column) -> Column:
        if self.regex is not None:
            return text.rlike(self.regex)
        searched = F.lower(text) if self.ignore_case else text
        found = searched.contains(self.words[0])
        for word in self.words[1:]:
            found = found | searched.contains(word)
        return found


@dataclass(frozen=True)
class SecretPattern:
    name: str
    category: str
    regex: str
    anchor: Anchor | None = None

    @property
    def marker(self) -> str:
        return f"[REDACTED:{self.category}]"


_HIT_FIELDS = (
    "category:string,original_snippet:string,redacted_snippet:string,pattern_name:string"
)
NUMBERED_HIT_TYPE = f"struct<line_number:bigint,{_HIT_FIELDS}>"

_KEY_PREFIXES = Anchor(("AKIA", "sk_live_", "FLWSECK-", "MK_PROD_", "sk-"))
_URI_SCHEMES = Anchor(("postgres://", "mysql://", "mongodb://", "redis://"))
_LONG_NUMBER = Anchor(regex=rf"{DIGIT}{{11}}")
# without its first and last letters, which have look-alikes of another case
_KEY_NAMES = Anchor(("pgcrypto", "ecret_"), ignore_case=True)

# What counts as a secret, in the order in which the patterns are applied.
DEFAULT_PATTERNS: list[SecretPattern] = [
    SecretPattern(
        "Cloud API Keys & DB Passwords",
        "GENERIC_SECRET",
        r"AKIA[0-9A-Z]{16}|sk_live_[a-zA-Z0-9]+|FLWSECK-[a-zA-Z0-9]+|MK_PROD_[a-zA-Z0-9]+"
        r"|sk-[a-zA-Z0-9]{20,}",
        _KEY_PREFIXES,
    ),
    SecretPattern(
        "Database Connection URIs",
        "DATABASE_URI",
        rf"(?:postgres|mysql|mongodb|redis)://{NON_SPACE}+",
        _URI_SCHEMES,
    ),
    SecretPattern(
        "Plaintext BVN",
        "PLAINTEXT_BVN",
        rf"(?iu:{WORD_START}bvn{SPACE}*[:=]{SPACE}*['\"]?{DIGIT}{{11}}['\"]?"
        rf"|['\"]2{DIGIT}{{10}}['\"])",
        _LONG_NUMBER,
    ),
    SecretPattern(
        "Plaintext NIN",
        "PLAINTEXT_NIN",
        rf"(?iu:{WORD_START}nin{SPACE}*[:=]{SPACE}*['\"]?{DIGIT}{{11}}['\"]?"
        rf"|['\"]1{DIGIT}{{10}}['\"])",
        _LONG_NUMBER,
    ),
    SecretPattern(
        "Plaintext Card PAN",
        "PLAINTEXT_PAN",
        rf"(?iu:{WORD_START}(?:card_number|pan){SPACE}*[:=]{SPACE}*['\"]?{DIGIT}{{16}}['\"]?"
        rf"|['\"]4{DIGIT}{{15}}['\"])",
        _LONG_NUMBER,
    ),
    SecretPattern(
        "Database Encryption Keys",
        "ENCRYPTION_KEY",
        rf"(?iu:(?:pgcrypto|secret_key){SPACE}*[:=]{SPACE}*['\"][^'\"]+['\"])",
        _KEY_NAMES,
    ),
]


def may_contain_secret(text: Column, patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS) -> Column:
    """Necessary condition for any hit in ``text`` (a line or many lines).

    A match inside one line is also a match in the whole text, and nothing is replaced before
    the first match, so a text without a match of any pattern cannot have a hit. Patterns that
    share an anchor test it once.
    """
    grouped: dict[Anchor | None, list[str]] = {}
    for pattern in patterns:
        grouped.setdefault(pattern.anchor, []).append(pattern.regex)
    result = F.lit(False)
    for anchor, regexes in grouped.items():
        matched = F.lit(False)
        for regex in regexes:
            matched = matched | text.rlike(regex)
        result = result | (matched if anchor is None else anchor.holds(text) & matched)
    return result


def mask(snippet: Column) -> Column:
    return F.concat(F.left(snippet, F.lit(4)), F.lit("***"))


def no_hits() -> Column:
    return F.expr(f"cast(array() as array<struct<{_HIT_FIELDS}>>)")


def _apply(pattern: SecretPattern, state: Column) -> Column:
    """One stage: hits of the pattern on the line as the earlier stages left it, then the marks."""

    def hit(found: Column) -> Column:
        return F.struct(
            F.lit(pattern.category).alias("category"),
            mask(found).alias("original_snippet"),
            F.lit(pattern.marker).alias("redacted_snippet"),
            F.lit(pattern.name).alias("pattern_name"),
        )

    def step(before: Column) -> Column:
        found = F.regexp_extract_all(before["line"], F.lit(pattern.regex), F.lit(0))
        return F.struct(
            F.regexp_replace(before["line"], pattern.regex, pattern.marker).alias("line"),
            F.concat(before["hits"], F.transform(found, hit)).alias("hits"),
        )

    return let(state, step)


def redact_line(line: Column, patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS) -> Column:
    """One line -> struct<line, hits>; lines without any secret skip the stages.

    The stages nest as arguments of one another, so every stage is evaluated once.
    """
    untouched = F.struct(line.alias("line"), no_hits().alias("hits"))
    state = untouched
    for pattern in patterns:
        state = _apply(pattern, state)
    return F.when(may_contain_secret(line, patterns), state).otherwise(untouched)


def redact_text(text: Column, patterns: Sequence[SecretPattern] = DEFAULT_PATTERNS) -> Column:
    """A whole text -> struct<text, hits>, hits numbered by line, lines handled one by one.

    Patterns may look across white space, so they are never applied to more than one line.
    """

    def number(state: Column, position: Column) -> Column:
        return F.transform(
            state["hits"],
            lambda h: F.struct(
                (position + 1).cast("bigint").alias("line_number"),
                h["category"].alias("category"),
                h["original_snippet"].alias("original_snippet"),
                h["redacted_snippet"].alias("redacted_snippet"),
                h["pattern_name"].alias("pattern_name"),
            ),
        )

    redacted = let(
        F.transform(lines_keeping_breaks(text), lambda s: redact_line(s, patterns)),
        lambda states: F.struct(
            F.array_join(F.transform(states, lambda s: s["line"]), "").alias("text"),
            F.flatten(F.transform(states, number)).alias("hits"),
        ),
    )
    none = F.expr(f"cast(array() as array<{NUMBERED_HIT_TYPE}>)")
    return F.when(may_contain_secret(text, patterns), redacted).otherwise(
        F.struct(text.alias("text"), none.alias("hits"))
    )
