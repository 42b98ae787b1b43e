"""Format strings of the dialects as Spark's datetime patterns. Translators read a format token by token."""

from __future__ import annotations

import re

#: strftime conversions (BigQuery) and template words (Redshift, Snowflake) with their patterns: fixed values.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "P": "a", "j": "DDD",
    "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "Z": "VV", "z": "xx", "Q": "Q", "k": "H", "l": "h",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "X": "HH:mm:ss", "x": "MM/dd/yy", "c": "EEE MMM d HH:mm:ss yyyy",
}
TEMPLATE = {
    "YYYY": "yyyy", "YYY": "yyy", "YY": "yy", "Y": "y", "MONTH": "MMMM", "MON": "MMM", "MMMM": "MMMM", "MM": "MM", "DAY": "EEEE", "DY": "EEE", "DDD": "DDD", "DD": "dd", "D": "d",
    "HH24": "HH", "HH12": "hh", "HH": "HH", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "FF9": "SSSSSSSSS", "FF6": "SSSSSS", "FF3": "SSS", "FF": "SSSSSS",
    "AM": "a", "PM": "a", "A.M.": "a", "P.M.": "a", "TZH": "x", "TZM": "", "TZ": "VV", "OF": "xxx", "Q": "Q",
}


def literal(text: str) -> str:
    """Letters and quotes of a pattern that stand for themselves."""
    return re.sub(r"[A-Za-z]+|'", lambda m: "''" if m[0] == "'" else f"'{m[0]}'", text)


def from_strftime(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] is None:
            return literal(m[0])
        code = m[1].lstrip("-E0123456789*O")
        if m[1] == "E4Y":
            return "yyyy"
        if m[1].endswith("S") and m[1][0] == "E":
            return "ss.SSSSSS"
        if code == "%":
            return "%"
        if code not in STRFTIME:
            raise ValueError(f"no pattern for %{m[1]}")
        pattern = STRFTIME[code]
        return pattern[0] if m[1][0] == "-" and set(pattern) <= set("MdHhms") else pattern

    return re.sub(r"%(-?E?[0-9*]?O?[A-Za-z%])|[^%]+", one, text)


def from_template(text: str) -> str:
    words = "|".join(re.escape(w) for w in sorted(TEMPLATE, key=len, reverse=True))

    def one(m: re.Match) -> str:
        if m[2] is not None:
            return literal(m[2])
        return TEMPLATE[m[1].upper()] if m[1] else literal(m[0])

    return re.sub(rf'({words})|"([^"]*)"|.', one, text, flags=re.I | re.S)


def is_temporal_template(text: str) -> bool:
    """Whether a TO_CHAR format is about dates: numbers' formats have 9 and 0 only."""
    return bool(re.search(r"YY|MM|DD|HH|MI|SS|MON|DAY|DY", text, re.I))


def number_format(text: str) -> str:
    """A number format in the words that Spark's to_char takes."""
    return re.sub(r"FM|L", lambda m: "" if m[0].upper() == "FM" else "$", text, flags=re.I)
