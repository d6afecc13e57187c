"""Path globs as regular expressions.

`*` and `?` also match `/`; `**` must be a whole path component and matches any
number of components. A pattern that is not valid matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def glob_to_regex(pattern: str) -> str | None:
    """The anchored regular expression of a glob, or None if it is not valid."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        char = pattern[i]
        if char == "*":
            stars = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            end = i + stars
            if stars > 2:
                return None
            if stars == 2:
                starts_component = i == 0 or pattern[i - 1] == "/"
                if not starts_component or (end < n and pattern[end] != "/"):
                    return None
                if end < n:
                    out.append("(?:.*/)?")
                    end += 1
                else:
                    out.append(".*")
            else:
                out.append(".*")
            i = end
        elif char == "?":
            out.append(".")
            i += 1
        elif char == "[":
            negated = pattern[i + 1:i + 2] == "!"
            first = i + 2 if negated else i + 1
            close = pattern.find("]", first + 1)
            if close < 0:
                return None
            out.append(_char_class(pattern[first:close], negated))
            i = close + 1
        else:
            out.append(re.escape(char))
            i += 1
    return "(?s)^" + "".join(out) + "$"


_WILDCARD = re.compile(r"\*\*/|\*+|\?|\[!?.[^\]]*\]", re.DOTALL)


def anchors(pattern: str) -> list[str]:
    """Texts of which a path must contain each for a valid glob to match, after a mark for their place.

    `=` is the whole path, `^` its beginning, `$` its end, `~` anywhere; `*` alone is a glob without literal text.
    Of the longest piece inside a path these are all its parts of 2^k characters, so that few lengths occur.
    """
    pieces = _WILDCARD.split(pattern)
    if len(pieces) == 1:
        return ["=" + pattern]
    ends = [mark + piece for mark, piece in (("^", pieces[0]), ("$", pieces[-1])) if piece]
    inner = max(pieces[1:-1], key=len, default="")
    size = 1 << (len(inner).bit_length() - 1) if inner else 0
    if len(inner) > max(len(pieces[0]), len(pieces[-1])) or not ends:
        ends += dict.fromkeys("~" + inner[i : i + size] for i in range(len(inner) - size + 1)) if inner else []
    return ends or ["*"]


def _char_class(body: str, negated: bool) -> str:
    ranges, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                ranges.append(f"{_in_class(low)}-{_in_class(high)}")
            i += 3
        else:
            ranges.append(_in_class(body[i]))
            i += 1
    if not ranges:
        return "." if negated else r"[^\x{0}-\x{10FFFF}]"
    return f"[{'^' if negated else ''}{''.join(ranges)}]"


def _in_class(char: str) -> str:
    return char if char.isalnum() else "\\" + char


def matches_glob(path: Column, pattern: str) -> Column:
    regex = glob_to_regex(pattern)
    return F.lit(False) if regex is None else path.rlike(regex)


def matches_any(path: Column, patterns) -> Column:
    """One expression for a list of globs."""
    regexes = [r for r in map(glob_to_regex, patterns) if r is not None]
    if not regexes:
        return F.lit(False)
    condition = path.rlike(regexes[0])
    for regex in regexes[1:]:
        condition = condition | path.rlike(regex)
    return condition
