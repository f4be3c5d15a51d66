"""Format-preserving pseudonyms for personal data.

Values are found by pattern, in ASCII digits, and validated: check digits, issuers'
first digits, octets, the calendar, numbers that are given out. What fails stays as it
is. Their variable part is read as a number below the count of values of that format,
and that number is permuted by a keyed Feistel network with cycle walking; a very long
part is permuted by a Feistel network over its characters, in linear time. Equal
values get equal pseudonyms in every document, different values of a format get
different ones, valid ones stay valid, and the key turns them back.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Longer values than this are permuted half by half, and not remembered.
LONG = 256
LETTERS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]++(?<=\w)@(?:[\w-]+\.)+[^\W\d_]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<![^\W_])[0-9a-fA-F]{32,}(?![^\W_])",
    "date": r"(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-])|(?<![\w./])(?P<sep>[0-9]{1,2}[./])[0-9]{1,2}[./][0-9]{4}(?![\w/])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?!\w)|(?<![\w(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<!\w)(?:[0-9][ -]?){12,18}[0-9](?!\w)",
}
# First digits that issuers of cards have, by the length of the number.
ISSUERS = re.compile(
    r"4(?=(?:.{12}|.{15}|.{18})\Z)|5[1-5](?=.{14}\Z)|(?:222[1-9]|22[3-9].|2[3-6]..|27[01].|2720)(?=.{12}\Z)|3[47](?=.{13}\Z)"
    r"|(?:30[0-5]|3[689])(?=.{11,12}\Z)|35(?=.{14,17}\Z)|(?:6011|64[4-9]|65)(?=.{12,17}\Z)"
)
FOUND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS.items()))
HINT = re.compile(r"[0-9@]|[0-9a-fA-F]{32}")


def feistel(number: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers below `size`."""
    half = max(((size - 1).bit_length() + 1) // 2, 1)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def mix(step: int, part: int) -> int:
        state = hashlib.shake_256(b"%d|%d|" % (len(key), step) + key + b"|%x|" % size + tweak + b"|" + part.to_bytes(width, "big"))
        return int.from_bytes(state.digest(width), "big") & mask

    while True:  # until the walk is back among the numbers below `size`
        left, right = number >> half, number & mask
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ mix(step, left), left
            else:
                left, right = right, left ^ mix(step, right)
        number = left << half | right
        if number < size:
            return number


def permuted(text: str, alphabets: list[str], key: bytes, tweak: str, back: bool = False) -> str:
    """The text with every character replaced by one of its alphabet, all of them together as one number."""
    if len(text) > LONG:
        return _permuted_long(text, alphabets, key, tweak.encode(), back)
    number, size = 0, 1
    for c, letters in zip(text, alphabets):
        number, size = number * len(letters) + letters.index(c), size * len(letters)
    if size == 1:
        return text
    number = feistel(number, size, key, tweak.encode(), back)
    out = []
    for letters in reversed(alphabets):
        number, at = divmod(number, len(letters))
        out.append(letters[at])
    return "".join(reversed(out))


def _permuted_long(text: str, alphabets: list[str], key: bytes, tweak: bytes, back: bool) -> str:
    """Like `permuted`, half by half: each character moves within its alphabet by an amount that the key and the other half give."""
    sizes = [len(letters) for letters in alphabets]
    places = [letters.index(c) for c, letters in zip(text, alphabets)]
    middle = len(text) // 2
    halves = slice(0, middle), slice(middle, len(text))
    lead = b"%d|" % len(key) + key + b"|%d|" % len(text) + tweak
    for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
        own, other = halves[step % 2], halves[1 - step % 2]
        state = hashlib.shake_256(lead + b"|%d|" % step + bytes(places[other]))
        count = own.stop - own.start
        stream = state.digest(4 * count)
        moves = (int.from_bytes(stream[4 * i : 4 * i + 4], "big") for i in range(count))
        places[own] = [(p - m if back else p + m) % size for p, m, size in zip(places[own], moves, sizes[own])]
    return "".join(letters[p] for p, letters in zip(places, alphabets))


def _inside(text: str, chosen: Callable[[str], bool], change: Callable[[str], str]) -> str:
    """Change the chosen characters as one string and put them back into their places."""
    new = iter(change("".join(c for c in text if chosen(c))))
    return "".join(next(new) if chosen(c) else c for c in text)


def _is_digit(c: str) -> bool:
    return c in LETTERS[0]


def _digits(text: str, key: bytes, tweak: str, back: bool) -> str:
    return _inside(text, _is_digit, lambda d: permuted(d, [LETTERS[0]] * len(d), key, tweak, back))


def luhn_digit(digits: str) -> str:
    """The check digit after these digits."""
    total = sum(n if i % 2 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _card(text: str, key: bytes, back: bool) -> str | None:
    bare = "".join(filter(_is_digit, text))
    issuer = ISSUERS.match(bare)
    if issuer is None or luhn_digit(bare[:-1]) != bare[-1]:
        return None
    first, rest = issuer.group(), bare[issuer.end() : -1]
    body = first + permuted(rest, [LETTERS[0]] * len(rest), key, f"card {first}", back)
    return _inside(text, _is_digit, lambda _: body + luhn_digit(body))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(text: str, key: bytes, back: bool) -> str | None:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34 or _iban_number(bare[4:] + bare[:4]) % 97 != 1:
        return None
    body = permuted(bare[4:], [LETTERS[0] if c.isdigit() else LETTERS[2] for c in bare[4:]], key, f"iban {bare[:2]}", back)
    new = f"{bare[:2]}{98 - _iban_number(f'{body}{bare[:2]}00') % 97:02d}{body}"
    return _inside(text, lambda c: c != " ", lambda _: new)


def _date(text: str, key: bytes, back: bool) -> str | None:
    iso = text[4:5] == "-"
    numbers = [int(n) for n in re.split(r"[-./]", text)]
    year, month, day = numbers if iso else reversed(numbers)
    american = not iso and month > 12
    if american:
        month, day = day, month
    if not (1 <= year and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    # Days of the century, so that dates stay near where they were.
    first = datetime.date(max(year // 100 * 100, 1), 1, 1).toordinal()
    last = datetime.date(year // 100 * 100 + 99, 12, 31).toordinal()
    number = datetime.date(year, month, day).toordinal() - first
    tweak = f"date {iso}"
    while True:
        number = feistel(number, last - first + 1, key, tweak.encode(), back)
        new = datetime.date.fromordinal(first + number)
        # Day and month are told apart by their size only where one is above 12.
        if iso or american == (american and new.day > 12):
            break
    if iso:
        return f"{new.year:04d}-{new.month:02d}-{new.day:02d}"
    parts = re.split(r"([./])", text)
    one, two = (new.month, new.day) if american else (new.day, new.month)
    return f"{one:0{len(parts[0])}d}{parts[1]}{two:0{len(parts[2])}d}{parts[3]}{new.year:04d}"


def _ip(text: str, key: bytes, back: bool) -> str | None:
    octets = [int(o) for o in text.split(".")]
    if max(octets) > 255:
        return None
    number = int.from_bytes(bytes(octets), "big")
    return ".".join(map(str, feistel(number, 1 << 32, key, b"ip", back).to_bytes(4, "big")))


def _phone(text: str, key: bytes, back: bool) -> str | None:
    if not 7 <= sum(map(_is_digit, text)) <= 15:
        return None
    code = re.match(r"\+\d{1,3}", text)
    place = code.end() if code else 0
    return text[:place] + _digits(text[place:], key, f"phone {text[:place]}", back)


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    # Areas 001 to 899 but not 666, groups from 01, serial numbers from 0001 on are given out.
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    number, serial = divmod(feistel(number, 898 * 99 * 9999, key, b"ssn", back), 9999)
    area, group = divmod(number, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _email(text: str, key: bytes, back: bool) -> str:
    name, _, suffix = text.rpartition(".")
    own = {c: letters for letters in LETTERS for c in letters}
    change = lambda s: permuted(s, [own[c] for c in s], key, "email", back)
    return f"{_inside(name, lambda c: c in own, change)}.{suffix}"


def _secret(text: str, key: bytes, back: bool) -> str:
    letters = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF" if text == text.upper() else ""
    mixed = [letters or (LETTERS[0] if c.isdigit() else "abcdef" if c.islower() else "ABCDEF") for c in text]
    return permuted(text, mixed, key, "secret", back)


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email, "iban": _iban, "secret": _secret, "date": _date, "ip": _ip, "phone": _phone,
    "ssn": _ssn, "card": _card,
}


@lru_cache(maxsize=100_000)
def _remembered(kind: str, value: str, key: bytes, back: bool) -> str | None:
    return KINDS[kind](value, key, back)


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or None if it is no valid value of its kind."""
    return _remembered(kind, value, key, back) if len(value) <= LONG else KINDS[kind](value, key, back)


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, int]:
    """A text with pseudonyms, and how many values it had."""
    if not HINT.search(text):
        return text, 0
    count = 0

    def replace(match: re.Match) -> str:
        nonlocal count
        kind = match.lastgroup if match.lastgroup != "sep" else "date"
        new = pseudonym(kind, match.group(), key, back)
        count += new is not None
        return match.group() if new is None else new

    return FOUND.sub(replace, text), count


def pseudonymised(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """All rows and columns of `docs` with pseudonyms in `text`, and n_values, how many were replaced.

    A null text stays null with no values, an empty one empty. Every row is treated by
    itself, whatever its doc_id, so repeated rows stay equal; a column n_values that
    `docs` already has is replaced. Digits beyond ASCII are text. Time is linear in a
    text's length.
    """
    rest = [c for c in docs.columns if c != "n_values"]
    at, secret = rest.index("text"), key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                done = [(None, 0) if t is None else pseudonymise(t, secret, back) for t in rows.column(at).to_pylist()]
                columns = list(rows.columns)
                columns[at] = pa.array([t for t, _ in done], rows.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], [*rows.schema.names, "n_values"])

    own = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = own.withColumn("n_values", F.lit(0).cast("long")).schema
    return own.mapInArrow(run, schema)
