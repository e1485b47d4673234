"""GLOB patterns as the cheapest predicate that means the same.

`*` matches any run of characters, slashes included, `?` one character, `[..]` and
`[^..]` a class; matching is case-sensitive and over the whole string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = "*?["


def to_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            negated = j < len(pattern) and pattern[j] == "^"
            j += negated
            start = j
            if j < len(pattern) and pattern[j] == "]":
                j += 1
            while j < len(pattern) and pattern[j] != "]":
                j += 1
            if j >= len(pattern):  # an unclosed class matches nothing
                return r"(?!)"
            body = pattern[start:j]
            safe = "".join("-" if ch == "-" and 0 < k < len(body) - 1 else "\\" + ch if not ch.isalnum() else ch for k, ch in enumerate(body))
            out.append(f"[{'^' * negated}{safe}]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def matches(column: Column, pattern: str) -> Column:
    """Equality and prefixes reach the Parquet scan; everything else is a regular expression."""
    if not any(c in pattern for c in SPECIAL):
        return column == pattern
    if pattern.endswith("*") and not any(c in pattern[:-1] for c in SPECIAL):
        return column.startswith(pattern[:-1])
    return column.rlike(to_regex(pattern))
