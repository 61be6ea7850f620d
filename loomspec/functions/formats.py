"""Date and time patterns: the closed registry, and their Java and strftime forms."""

from __future__ import annotations

import re

#: The patterns that specifications may declare.
DATE_PATTERNS = ("YYYY-MM-DD", "YYYY/MM/DD", "MM/DD/YYYY", "MM-DD-YYYY", "M/D/YYYY", "M/d/YYYY", "M/d/yyyy", "YYYYMMDD", "MMDDYYYY")
DATETIME_PATTERNS = (
    "YYYY-MM-DD HH:MM:SS", "YYYY-MM-DDTHH:MM:SS", "YYYY-MM-DD HH:MM", "MM/DD/YYYY HH:MM:SS", "MM/DD/YYYY hh:mm:ss A", "M/D/YYYY h:mm A", "M/d/YYYY h:mm A", "M/d/yyyy h:mm a", "M/d/yyyy, h:mm a",
    "MM/dd/yyyy h:mma", "MM/dd/yyyy h:mmA", "MM/DD/YYYY hh:mm A", "M/D/YYYY, h:mm A", "M/D/YYYY h:mm:ss A", "YYYY-MM-DD HH:mm:ss", "YYYY-MM-DD HH:MM:SS.SSSSSS", "YYYY-MM-DD HH:MM:SS.SSS",
)
TIME_PATTERNS = ("HH:MM:SS", "HH:MM", "hh:mm:ss A", "hh:mm A", "h:mm a")
PATTERNS = DATE_PATTERNS + DATETIME_PATTERNS + TIME_PATTERNS
EPOCH_MS, EXCEL_SERIAL = "EPOCH_MS", "EXCEL_SERIAL"
#: Tried in this order where a value may be in any of several forms.
COMMON_DATES = ("YYYY-MM-DD", "MM/DD/YYYY", "M/D/YYYY", "YYYYMMDD", "YYYY/MM/DD")
COMMON_TIMESTAMPS = ("YYYY-MM-DD HH:MM:SS", "YYYY-MM-DDTHH:MM:SS", "YYYY-MM-DD HH:MM:SS.SSS", "YYYY-MM-DD HH:MM:SS.SSSSSS", "MM/DD/YYYY HH:MM:SS", "M/D/YYYY h:mm A")

_TOKEN = re.compile(r"\.S+|Y+|y+|M+|m+|D+|d+|H+|h+|S+|s+|A|a|T|.", re.S)


def _tokens(pattern: str) -> list[tuple[str, str]]:
    """(field, text): the M of minutes are those that come after hours."""
    out, after_hours = [], False
    for text in _TOKEN.findall(pattern):
        kind = text[0]
        if kind in "Hh":
            after_hours = True
            out.append(("hour24" if kind == "H" else "hour12", text))
        elif kind == "M":
            # a compact time has its minutes right after the hours: MMSS
            out.append(("minute" if after_hours else "month", text))
        elif kind in "mSsDdYyAaT":
            out.append(({"m": "minute", "S": "second", "s": "second", "D": "day", "d": "day", "Y": "year", "y": "year", "A": "half", "a": "half", "T": "literal"}[kind], text))
        elif text[0] == "." and len(text) > 1:
            out.append(("fraction", text))
        else:
            out.append(("other", text))
    return out


def checked(pattern: str) -> str:
    """The pattern, if specifications may declare it; a value of a form that is not known would be read as NULL without a word."""
    if pattern not in PATTERNS and pattern not in (EPOCH_MS, EXCEL_SERIAL):
        raise ValueError(f"unknown date pattern {pattern!r}")
    return pattern


def to_java(pattern: str) -> str:
    """The pattern for to_timestamp and date_format."""
    made = {"year": lambda t: "y" * len(t), "month": lambda t: t, "day": lambda t: "d" * len(t), "hour24": lambda t: "H" * len(t), "hour12": lambda t: "h" * len(t), "minute": lambda t: "m" * len(t), "second": lambda t: "s" * len(t), "half": lambda t: "a", "literal": lambda t: "'T'", "fraction": lambda t: t, "other": lambda t: t if not t.isalpha() else f"'{t}'"}
    return "".join(made[k](t) for k, t in _tokens(pattern))


def to_strftime(pattern: str) -> str:
    names = {"year": "%Y", "day": "%d", "hour24": "%H", "hour12": "%I", "minute": "%M", "second": "%S", "half": "%p", "literal": "T"}
    out = []
    for kind, text in _tokens(pattern):
        if kind == "month":
            out.append({1: "%m", 2: "%m", 3: "%b"}.get(len(text), "%B"))
        elif kind == "fraction":
            out.append(".%f")
        else:
            out.append(names.get(kind, text))
    return "".join(out)


def strict_regex(pattern: str) -> str:
    """What a value must look like for Spark to parse it: two letters want two digits, one takes one or two."""
    out = []
    for kind, text in _tokens(pattern):
        if kind == "year":
            out.append(rf"\d{{{len(text)}}}")
        elif kind in ("day", "hour24", "hour12", "minute", "second") or kind == "month" and len(text) < 3:
            out.append(r"\d{2}" if len(text) == 2 else r"\d{1,2}")
        elif kind == "month":
            out.append("[A-Za-z]{3}" if len(text) == 3 else "[A-Za-z]{3,9}")
        elif kind == "fraction":
            out.append(rf"\.\d{{1,{len(text) - 1}}}")
        elif kind == "half":
            out.append("[AaPp][Mm]")
        else:
            out.append(re.escape(text))
    return "".join(out)


#: Strftime directives and their Java letters.
_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM"}


def strftime_to_java(pattern: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            if m[1] not in _DIRECTIVES:
                raise ValueError(f"directive %{m[1]}")
            return _DIRECTIVES[m[1]]
        return f"'{m[2]}'"

    return re.sub(r"%(.)|([A-Za-z]+)", one, pattern)


def candidates(declared: str | None, fallbacks: tuple[str, ...] = (), common: tuple[str, ...] = ()) -> list[str]:
    """The declared pattern, then fallbacks, then common ones, each once."""
    return list(dict.fromkeys([*([declared] if declared else []), *fallbacks, *common]))
