"""Text functions that match Python's ``strip``, ``casefold`` and number parsing, as SQL
text over built-in functions."""

from __future__ import annotations

import json
from functools import lru_cache

from plumbline.functions.columns import literal

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What counts as a number written as text, with a decimal point or comma.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
COMMA_NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+,?\d*|,\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"

DISPLAY_CHARACTERS = 120


def strip_sql(value: str) -> str:
    return f"btrim({value}, {literal(WHITESPACE)})"


@lru_cache(maxsize=1)
def _casefold_rules() -> tuple[dict[str, str], dict[str, str]]:
    """The characters casefold changes, from Python's Unicode tables: those that fold to
    one character (ASCII capitals included) and those that fold to several."""
    single, several = {}, {}
    for point in range(0x110000):
        char = chr(point)
        folded = char.casefold()
        if folded != char:
            (single if len(folded) == 1 else several)[char] = folded
    return single, several


def _character_class(characters) -> str:
    """A regex class with neighbouring characters joined into ranges."""
    points = sorted(map(ord, characters))
    starts = [p for p in points if p - 1 not in points]
    ends = [p for p in points if p + 1 not in points]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


@lru_cache(maxsize=1)
def _fold_template() -> str:
    single, several = _casefold_rules()
    sharp = "\u00df"
    rest = {char: folded for char, folded in several.items() if char != sharp}
    translated = (f"replace(translate({{s}}, {literal(''.join(single))}, {literal(''.join(single.values()))}), "
                  f"'{sharp}', '{several[sharp]}')")
    table = f"from_json({literal(json.dumps(rest))}, 'map<string,string>')"
    replaced = (f"array_join(transform(transform(sequence(1, length({translated})), "
                f"i -> substr({translated}, i, 1)), ch -> coalesce(try_element_at({table}, ch), ch)), '')")
    return (r"(case when not {s} rlike r'[^\x00-\x7F]' then lower({s}) "
            f"when not {{s}} rlike r'{_character_class(rest)}' then {translated} else {replaced} end)")


def fold_sql(value: str) -> str:
    """``casefold()`` of a text; strip it first for the comparison form.

    ASCII strings take ``lower``; others one ``translate``, and only those holding a
    character that folds to several (other than the common sharp s) a look at every
    character. CASE is lazy, so each string pays for its own branch alone.
    """
    return _fold_template().replace("{s}", value)


def number_sql(value: str, decimal: str = ".") -> str:
    """The number a text spells, or NULL. Type suffixes, ``nan`` and overflow are refused."""
    pattern = COMMA_NUMBER_PATTERN if decimal == "," else NUMBER_PATTERN
    plain = f"replace({value}, ',', '.')" if decimal == "," else value
    parsed = f"try_cast({strip_sql(plain)} as double)"
    return (f"(case when {value} rlike r'{pattern}' and (abs({parsed}) < double('inf') "
            f"or contains(lower({value}), 'inf')) then {parsed} end)")


def is_number_sql(value: str, decimal: str = ".") -> str:
    return f"({number_sql(value, decimal)} is not null)"


def quoted_sql(value: str) -> str:
    """Padded strings in quotes, so that "SP" and " SP " can be told apart."""
    return f"(case when {value} <> {strip_sql(value)} then concat('\\'', {value}, '\\'') else {value} end)"


def display_sql(value: str) -> str:
    """The example form: quoted when padded, at most 120 characters."""
    return f"substring({quoted_sql(value)}, 1, {DISPLAY_CHARACTERS})"
