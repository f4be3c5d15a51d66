"""Shell-style globs as one alternation regex per pattern list."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.paths import prefixes


def _tokens(glob: str) -> Iterator[str]:
    pos = 0
    while pos < len(glob):
        char = glob[pos]
        if char == "*":
            yield ".*"
        elif char == "?":
            yield "."
        elif char == "[":
            # A set closes at the first ] that is not its first member.
            first = pos + 2 if glob[pos + 1 : pos + 2] == "!" else pos + 1
            end = glob.find("]", first + 1)
            if end < 0:
                yield r"\["
            else:
                yield _char_set(glob[first:end], negated=first == pos + 2)
                pos = end
        else:
            yield char if char.isalnum() or ord(char) > 127 else "\\" + char
        pos += 1


def _char_set(body: str, negated: bool) -> str:
    ranges, pos = [], 0
    while pos < len(body):
        wide = body[pos + 1 : pos + 2] == "-" and pos + 2 < len(body)
        low, high = body[pos], body[pos + 2] if wide else body[pos]
        if low <= high:
            ranges.append(rf"\x{{{ord(low):x}}}-\x{{{ord(high):x}}}")
        pos += 3 if wide else 1
    if not ranges:
        return "." if negated else "(?!)"
    return "[" + ("^" if negated else "") + "".join(ranges) + "]"


def glob_regex(glob: str) -> str:
    """Body of the regex for one glob; `*` also crosses `/`."""
    return "".join(_tokens(glob))


def _alternation(globs: Sequence[str]) -> str:
    return "(?:" + "|".join(glob_regex(g) for g in globs) + ")"


def glob_match(text: Column, globs: Sequence[str], case_sensitive: bool = True) -> Column:
    """True when the whole text matches any glob."""
    if not globs:
        return F.lit(False)
    flags = "(?s)" if case_sensitive else "(?siu)"
    return text.rlike(rf"{flags}\A{_alternation(globs)}\z")


def node_match(path: Column, globs: Sequence[str], case_sensitive: bool = True) -> Column:
    """True when a node's base name or its whole relative path matches any glob."""
    if not globs:
        return F.lit(False)
    flags = "(?s)" if case_sensitive else "(?siu)"
    # The optional group skips the directory part, provided no slash is left.
    return path.rlike(rf"{flags}\A(?:(?:.*/)?(?=[^/]*\z))?{_alternation(globs)}\z")


def any_level_match(path: Column, globs: Sequence[str], case_sensitive: bool = True) -> Column:
    """True when the file or any directory above it matches."""
    if not globs:
        return F.lit(False)
    return F.exists(prefixes(path), lambda p: node_match(p, globs, case_sensitive))
