"""Pseudonyms of odd and very long rows, and against a detector of its own."""

from __future__ import annotations

import collections
import re
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import pii

KEY = b"k"
ODD = [
    "+٩٦٦ ٥٥ ١٢٣ ٤٥٦٧", "０１２-３４５-６７８９", "٢٠٢٤-٠٢-٢٩ and ٤١١١١١١١١١١١١١١١", "१.२.३.४ ५", "²³¹@a.de",
    "a" * 4000, "0123456789abcdef" * 5000, "A" * 5000 + "g", "@" * 3000, "a@" * 3000, "1" * 20000, "1-" * 5000, "a." * 5000 + "@b.de", "DE" * 3000,
    "x" * 5000 + "@" + "y" * 5000 + ".com", "", " ", "é" * 300 + "@b.de",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_are_turned_back(text):
    new, count = pii.pseudonymise(text, KEY)
    assert pii.pseudonymise(new, KEY, back=True)[0] == text
    assert len(new) == len(text) and (count > 0) == (new != text)


def test_foreign_digits_stay():
    for text in ODD[:4]:
        assert pii.pseudonymise(text, KEY) == (text, 0)


@pytest.mark.parametrize("unit", ["w", "a", "ab1.", "7", "x@", "4111 ", "f" * 40 + " ", "a-", "1.2.", "é", "AB12 "])
def test_megabyte_in_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    new, _ = pii.pseudonymise(text, KEY)
    assert time.perf_counter() - began < 20 and len(new) == len(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789abcdef", min_size=250, max_size=700), st.binary(min_size=1, max_size=8))
def test_long_values_are_permuted(value, key):
    new = pii.permuted(value, ["0123456789abcdef"] * len(value), key, "t")
    assert new != value and pii.permuted(new, ["0123456789abcdef"] * len(value), key, "t", True) == value


def test_all_rows_of_any_table(spark):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, None, 7), (3, None, None), (None, "a.b@c.de", 7), (3, "a.b@c.de", 7), (3, "a.b@c.de", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_values int").repartition(3)
    got = pii.pseudonymised(table, "k")
    assert got.columns == ["doc_id", "text", "n_values"]
    want = collections.Counter((i, *((None, 0) if t is None else pii.pseudonymise(t, KEY))) for i, t, _ in rows)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    back = pii.pseudonymised(got, "k", back=True).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((i, t) for i, t, _ in rows)
    assert pii.pseudonymised(table.limit(0), "k").count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def detected(word):
    """What kind a word of its own is, without the operator's patterns."""
    if word.count("@") == 1 and word.isascii():
        name, host = word.split("@")
        if name and "." in host and all(host.split(".")) and all(c in string.ascii_letters + string.digits + "._-+%" for c in name + host):
            return "email"
    if word.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in word.split(".")):
        return "ip"
    if len(word) == 16 and word.isascii() and word.isdigit() and word[0] == "4" and luhn(word):
        return "card"
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", word) and word[:3] not in ("000", "666") and word[0] != "9" and word[4:6] != "00" and word[7:] != "0000":
        return "ssn"
    if len(word) >= 32 and set(word) <= set("0123456789abcdef"):
        return "secret"
    return None


def test_against_a_plain_detector(spark):
    """Every word that the plain detector knows is replaced by one of its kind, everywhere alike; words without digits or @ stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = {r.doc_id: r.text or "" for r in table.collect()}
    new = {r.doc_id: r.text or "" for r in pii.pseudonymised(table, "k").collect()}
    pairs, seen = {}, collections.Counter()
    for doc_id, text in old.items():
        words, others = text.split(), new[doc_id].split()
        assert len(words) == len(others)
        for word, other in zip(words, others):
            kind = detected(word.rstrip(".,;:!?"))
            if kind:
                seen[kind] += 1
                assert detected(other.rstrip(".,;:!?")) == kind and other != word
                assert pairs.setdefault(word, other) == other
            elif not re.search("[0-9@]", word):
                assert word == other or re.fullmatch("[a-fA-F]{32,}.?", word)
    assert seen["email"] > 5 and seen["card"] > 2 and len(set(pairs.values())) == len(pairs)
