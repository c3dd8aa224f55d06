"""Glob patterns over keys: `*`, `?`, `[abc]`, `[a-z]`, `[^a]` or `[!a]`; no escape."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _class(pattern: str, at: int) -> tuple[str, int]:
    """The regex of a bracket class that opens at `at`, and the place after it.

    The first character of a class is a member even if it is `]`; a class that is never closed ends with the pattern.
    """
    start = at + 1
    negated = pattern[start : start + 1] in ("^", "!")
    start += negated
    end = pattern.find("]", start + 1)
    body, end = (pattern[start:], len(pattern)) if end < 0 else (pattern[start:end], end + 1)
    out, i = "", 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            lo, hi = body[i], body[i + 2]
            if lo <= hi:
                out += f"{re.escape(lo)}-{re.escape(hi)}"
            i += 3
        else:
            out += re.escape(body[i])
            i += 1
    if not out:  # a class of nothing matches nothing; its negation matches any one character
        return (r"[\s\S]" if negated else r"(?!)"), end
    return f"[{'^' if negated else ''}{out}]", end


def glob_to_regex(pattern: str) -> str:
    """An anchored regex, alike for Java, RE2 and Python."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += r"[\s\S]*"
        elif c == "?":
            out += r"[\s\S]"
        elif c == "[":
            found, i = _class(pattern, i)
            out += found
            continue
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(text: Column, pattern: str) -> Column:
    """Whether `text` (STRING) matches. `lit`, `lit*` and `*` become an equality, a prefix and a null test; see `key_match` for binary keys."""
    special = [i for i, c in enumerate(pattern) if c in "*?["]
    if not special:
        return text == pattern
    if special[0] == len(pattern) - 1 and pattern[-1] == "*":
        return F.startswith(text, F.lit(pattern[:-1])) if len(pattern) > 1 else text.isNotNull()
    regex = glob_to_regex(pattern)[:-1]
    return text.rlike(regex[: -len(r"[\s\S]*")] if pattern[-1] == "*" else regex + r"\z")


def literal_prefix(pattern: str) -> str:
    """What every match begins with."""
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0]


def key_match(key: Column, pattern: str) -> Column:
    """Whether a binary key matches. What the pattern begins with becomes a range of keys, which reaches the scan as a filter; nothing
    else is tested if the pattern is `lit` or `lit*`.
    """
    head = literal_prefix(pattern).encode("latin-1", "replace") if pattern.isascii() else None
    if head is None:
        return glob_match(F.decode(key, "ISO-8859-1"), pattern.encode().decode("latin-1"))
    if len(head) == len(pattern):
        return key == F.lit(head)
    end = head.rstrip(b"\xff")
    inside = key >= F.lit(head)
    if end:
        inside = inside & (key < F.lit(end[:-1] + bytes([end[-1] + 1])))
    return inside if pattern[len(head) :] == "*" else inside & glob_match(F.decode(key, "ISO-8859-1"), pattern)


@F.pandas_udf(T.StringType())
def glob_regex(pattern: pd.Series) -> pd.Series:
    """`glob_to_regex` for a column of patterns; null of null."""
    return pattern.map(lambda p: None if p is None else glob_to_regex(p)[:-1] + r"\z")
