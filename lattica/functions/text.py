"""Text matching in the dialects that the query catalogue is defined in, as built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII letters in either case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def ascii_fold(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def like_ascii(value: Column, pattern: str) -> Column:
    """LIKE that folds ASCII letters only, in which % and _ are always wildcards and nothing escapes them."""
    return ascii_fold(value).like(pattern.translate(_FOLD).replace("\\", "\\\\"))


def contains_like(value: Column, text: str) -> Column:
    """LIKE %text%; wildcards within the text are live. A plain text becomes a substring search."""
    if not set(text) & set("%_\\"):
        return F.contains(ascii_fold(value), F.lit(text.translate(_FOLD)))
    return like_ascii(value, f"%{text}%")


def unicode_regex(pattern: str) -> str:
    """A pattern with Unicode classes for the JVM's engine. Look-around and back-references are refused, as an automaton
    that matches in linear time has neither."""
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        raise ValueError(f"look-around and back-references aren't supported: {pattern!r}")
    return "(?U)" + pattern


def check_regex(pattern: str, what: str) -> None:
    try:
        re.compile(pattern)
        unicode_regex(pattern)
    except (re.error, ValueError) as e:
        raise ValueError(f"{what} is no valid pattern: {e}") from None


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def short_name(qualified: Column) -> Column:
    """The last two parts of a name qualified by ::."""
    parts = F.split(qualified, "::")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "::")).otherwise(qualified)


def lines_of(text: Column) -> Column:
    """The lines of a text: ended by \\n or \\r\\n, without an empty one after the last end."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def suffixes_stripped(value: Column, suffixes: tuple[str, ...]) -> Column:
    """value without any repetition of each suffix at its end, one suffix after the other."""
    for s in suffixes:
        value = F.regexp_replace(value, f"(?:{s})+$", "")
    return value
