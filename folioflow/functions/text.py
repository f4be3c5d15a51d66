"""Lines, whitespace, escaping, redaction and text measures."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.defaults import ARTIFACT_LABELS, BUILTINS, KEYWORDS, REDACTED, SECRET_HINTS

# Every line boundary: CRLF, or one of LF CR VT FF FS GS RS NEL LS PS.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_OTHER_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Whitespace of Unicode plus the four information separators.
_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name `value` inside an expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(value: Column) -> Column:
    """Have an expensive expression evaluated where it is written.

    The optimizer copies a column's expression into every filter above it that
    names the column. It does not do so with a value that could vary, which the
    (always true) condition makes it look like; unused columns are still pruned.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    # Most texts have no break but LF, and one character is much faster to split at.
    plain = lambda whole: F.when(whole.rlike(_OTHER_BREAK), F.split(whole, LINE_BREAK, -1)).otherwise(F.split(whole, "\n", -1))
    return let(
        let(text, plain),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){_SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"(?U)\A{_SPACE}*\z")


def normalize_line(line: Column) -> Column:
    """Trim, then one space for each run of whitespace."""
    return F.regexp_replace(strip(line), rf"(?U){_SPACE}+", " ")


# Whitespace beyond ASCII that does not break lines.
_WIDE_SPACES = [chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]


def is_even(line: Column) -> Column:
    """A cheap test that only lines pass which `normalize_line` leaves as they are.

    For a line of a text (it holds no line break): the only whitespace is single
    spaces, none of them at an end.
    """
    odd = [line.startswith(" "), line.endswith(" "), *[line.contains(x) for x in ("  ", "\t", "\x1f")]]
    wide = (F.octet_length(line) > F.length(line)) & reduce(or_, [line.contains(x) for x in _WIDE_SPACES])
    return ~(reduce(or_, odd) | wide)


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode_text(raw: Column) -> Column:
    """Bytes to text: UTF-8 where valid, Latin-1 otherwise; line ends become LF."""
    as_utf8 = raw.cast("string")
    return unify_newlines(F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(raw, "ISO-8859-1")))


def escape_attr(text: Column) -> Column:
    """Escape for an attribute value, both quotes included."""
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_content(text: Column, mode: str = "minimal") -> Column:
    """Escape element text: `minimal` handles & and <, `none` leaves it alone."""
    if mode == "none":
        return text
    if mode != "minimal":
        raise ValueError(f"unknown escape mode {mode!r}")
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def secret_regex(pattern: str) -> str:
    """A user's pattern for the JVM: checked here, case ignored, Unicode classes."""
    re.compile(pattern)
    named = pattern.replace("(?P<", "(?<")
    named = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", named)
    return "(?iuU)" + named.replace(r"\Z", r"\z")


# Letters that a case-blind search takes for s, i or k, but that lower() leaves apart.
_FOLDED_TWINS = ["\u017f", "\u0131", "\u0130", "\u212a"]
# Syntax whose outcome in a line may differ from its outcome in the whole text.
_SEES_LINE_ENDS = re.compile(r"[\^$]|\\[ABGZz0-9]|\(\?[^:]|[*+?}]\+")


def may_hold_secret(text: Column, patterns: Sequence[str], hints: Mapping[str, str]) -> Column | None:
    """A cheap test that no text with a match fails; None if a pattern allows none."""
    hinted = {hints[p] for p in patterns if p in hints}
    others = [p for p in patterns if p not in hints]
    if any(_SEES_LINE_ENDS.search(p.replace("[^", "[")) for p in others):
        return None
    tests = [text.rlike(secret_regex(p)) for p in others]
    if hinted:
        tests += [text.contains(twin) for twin in _FOLDED_TWINS]
        tests.append(let(F.lower(text), lambda low: reduce(or_, [low.contains(h) for h in sorted(hinted)])))
    return reduce(or_, tests)


def redact_secrets(text: Column, patterns: Sequence[str], hints: Mapping[str, str] = SECRET_HINTS) -> Column:
    """Struct (content, scrubbed): every match in every line replaced.

    Lines are joined again only where something matched, so an untouched text
    keeps its final newline and its own separators. Texts that cannot hold a
    match are not cut into lines at all.
    """
    untouched = F.struct(text.alias("content"), F.lit(False).alias("scrubbed"))
    if not patterns:
        return untouched
    regexes = [secret_regex(p) for p in patterns]
    suspicious = may_hold_secret(text, patterns, hints)

    def scrub(line: Column) -> Column:
        clean = line
        for regex in regexes:
            clean = F.regexp_replace(clean, regex, REDACTED)
        if suspicious is None:
            return clean
        return F.when(may_hold_secret(line, patterns, hints), clean).otherwise(line)

    searched = let(
        split_lines(text),
        lambda lines: let(
            F.transform(lines, scrub),
            lambda clean: F.struct(
                F.when(clean == lines, text).otherwise(F.array_join(clean, "\n")).alias("content"),
                (clean != lines).alias("scrubbed"),
            ),
        ),
    )
    return searched if suspicious is None else F.when(suspicious, searched).otherwise(untouched)


def sha1_content(text: Column) -> Column:
    return F.sha1(F.encode(text, "UTF-8"))


def _tenths(size: Column, unit: int) -> Column:
    """size/unit with one decimal, ties to even, in integer arithmetic."""
    scaled = size.cast("long") * 10
    whole, rest = F.floor(scaled / unit), F.pmod(scaled, F.lit(unit))
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (F.pmod(whole, F.lit(2)) == 1))
    tenths = (whole + up.cast("long")).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def format_size(size: Column) -> Column:
    kib, mib = 1024, 1024 * 1024
    return (
        F.when(size < kib, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mib, F.concat(_tenths(size, kib), F.lit(" KB")))
        .otherwise(F.concat(_tenths(size, mib), F.lit(" MB")))
    )


def format_mtime(epoch_s: Column) -> Column:
    """yyyy-MM-dd HH:mm in UTC, whatever the session's zone."""
    second = F.floor(epoch_s).cast("long")
    day = F.date_from_unix_date(F.floor(second / 86400).cast("int"))
    minute = F.floor(F.pmod(second, F.lit(86400)) / 60).cast("int")

    def two(n: Column) -> Column:
        return F.lpad(n.cast("int").cast("string"), 2, "0")

    return F.concat(day.cast("string"), F.lit(" "), two(F.floor(minute / 60)), F.lit(":"), two(F.pmod(minute, F.lit(60))))


def text_stats(text: Column) -> Column:
    """Struct (words, characters)."""
    words = F.filter(F.split(text, rf"(?U){_SPACE}+", -1), lambda w: w != "")
    return F.struct(F.size(words).cast("long").alias("words"), F.length(text).cast("long").alias("characters"))


def _word(*alternatives: str) -> str:
    return r"(?<![0-9A-Za-z_])(?:" + "|".join(alternatives) + r")(?![0-9A-Za-z_])"


# One pattern per highlighted class; word boundaries are ASCII, strings end with their line.
LEXICAL_CLASSES = {
    "keywords": _word(*KEYWORDS),
    "self_cls": _word("self", "cls"),
    "builtins": _word(*BUILTINS),
    "decorators": r"@[a-zA-Z_][a-zA-Z0-9_]*",
    "definitions": r"(?<![0-9A-Za-z_])(?:class|def)[ \t]+[a-zA-Z_][a-zA-Z0-9_]*",
    "magic_names": _word("__[0-9A-Za-z_]+__"),
    "numbers": _word(
        r"0[xX][0-9a-fA-F]+[lL]?", r"0[bB][01]+[lL]?", r"[0-9]+\.[0-9]+(?:e[+-]?[0-9]+)?", r"[0-9]+[lL]?"
    ),
    "single_quoted": r"'(?:[^'\\\n]|\\[^\n])*+'",
    "double_quoted": r'"(?:[^"\\\n]|\\[^\n])*+"',
    "comments": r"#[^\n]*",
    "braces": r"[{}()\[\]]",
}


def lexical_profile(text: Column) -> dict[str, Column]:
    """Matches per lexical class, as one column per class."""
    return {name: F.regexp_count(text, F.lit(rx)).cast("long") for name, rx in LEXICAL_CLASSES.items()}


def drop_artifact_lines(lines: Column) -> Column:
    """Remove lines that only name a language or say Copy."""
    label = r"(?iU)\A(?:" + "|".join(ARTIFACT_LABELS) + rf"){_SPACE}*\z"
    return F.filter(lines, lambda line: ~line.rlike(label))
