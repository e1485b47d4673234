"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case letters up to U+024F that decompose, and the base letter they lose their marks to.
_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<") and chr(c).lower() == chr(c)]
ACCENTED = "".join(_ACCENTED)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, also where f uses it inside a lambda."""
    return F.transform(F.array(value), f)[0]


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters, digits and private-use characters, in lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit(TOKEN), F.lit(0))


def folded(text: Column) -> Column:
    """Text in lower case, whose runs of ASCII letters, digits and other characters beyond ASCII are its `tokens`, accents aside.

    Only texts with such characters need the classes of Unicode; operators.inverted cuts the runs out and takes the accents.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    between = TOKEN.replace("[", "[^", 1)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.regexp_replace(low, between, " "))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trivial(text: Column) -> Column:
    """At most one character after trimming, or one word of at most 20 bytes."""
    t = F.trim(text)
    return (F.length(t) <= 1) | ((F.instr(t, " ") == 0) & (F.octet_length(t) <= 20))


def line_count(text: Column) -> Column:
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(breaks + F.when(F.right(text, F.lit(1)) == "\n", F.lit(0)).otherwise(F.lit(1))).cast("int")


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop before white space or the end; the whole text if there is none."""
    found = F.regexp_extract(text, r"(?s)^(.*?\.)(\s|$)", 1)
    return F.when(found != "", found).otherwise(text)


def split_docstring(text: Column) -> tuple[Column, Column]:
    """(title, description): the first line, and the first sentence of the first paragraph after it."""
    clean = F.trim(text)
    rest = F.when(F.instr(clean, "\n") > 0, F.regexp_replace(clean, r"(?s)^[^\n]*\n\s*", "")).otherwise(F.lit(""))
    paragraph = F.regexp_replace(F.regexp_extract(rest, r"(?s)^(.*?)(\n\s*\n|$)", 1), r"\s*\n\s*", " ")
    description = F.trim(first_sentence(paragraph))
    return first_line(clean), F.when(description != "", description)


def identifiers(text: Column, stop: list[str]) -> Column:
    """Distinct identifiers of two characters or more that are not in `stop`, sorted."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    kept = F.filter(F.array_distinct(found), lambda w: F.length(w) >= 2)
    return F.array_sort(F.array_except(kept, F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")))
