"""Vector codes, the source schedule and periodic runs against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import mixing, periodic, vectorcodes
from folioflow.llm.queries import QUERIES
from tests.llm.test_operators import docs, odd_rows, prose  # noqa: F401

# ---- periodic runs


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length, s = j - i + q, words[i : j + q]
            if j > i and length >= max(6, 4 * q) and not any(s[: length - d] == s[d:] for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


@pytest.mark.parametrize("full", [64, 1, 3])
def test_runs_are_brute_force(monkeypatch, full):
    monkeypatch.setattr(periodic, "FULL_LAGS", full)
    rnd = random.Random(full)
    for _ in range(600):
        n, k = rnd.randint(1, 90), rnd.choice([1, 2, 3, 5, 20])
        words = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            a, p = rnd.randrange(n), rnd.randint(1, 12)
            for i in range(a + p, min(n, a + rnd.randint(1, 60))):
                words[i] = words[i - p]
        assert periodic.find_runs(np.array(words)) == brute_runs(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_segments_hold_all_runs(words):
    parts = periodic.surviving(np.array(words))
    for start, length, _ in brute_runs(words):
        assert any(a <= start and start + length <= b for a, b in parts)


def test_runs_of_very_long_texts():
    n = 300_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n) % 5000) == [(0, n, 5000)]
    rng = np.random.default_rng(0)
    words = rng.integers(0, 200, n)
    words[100_000:200_000] = np.resize(words[100_000:112_345], 100_000)
    (start, length, period), = periodic.find_runs(words)
    assert period == 12_345 and start <= 100_000 and start + length >= 200_000


def expected_runs(doc_id, text, alter):
    words = (text or "").encode().split()
    n = len(words)
    number = zlib.crc32(str(doc_id).encode())
    if alter and doc_id is not None and n and number % 10 == 0:
        a = (number // 10) % n
        p = 1 + (n - a) // (3 + (number // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    first = best[0] if best else (None,) * 3
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, 1000 * best[0][1] // best[0][2] if best else None, listed, left.decode())


def test_collapse_runs(spark, odd_rows):  # noqa: F811
    rows = odd_rows + [(i, t) for i, t in enumerate(prose(7, 60), 100)] + [(500, "x y z " * 3 + "x y"), (501, "a a a a a a " * 200)]
    for alter in (None, periodic.periodic_tail):
        got = periodic.collapse_runs(docs(spark, rows), alter).collect()
        listed = ["".join(f"{r.start},{r.length},{r.period}\n" for r in row.runs) for row in got]
        ours = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, runs, r.collapsed) for r, runs in zip(got, listed)]
        assert collections.Counter(ours) == collections.Counter(expected_runs(i, t, alter) for i, t in rows)
    assert sum(expected_runs(i, t, True)[1] for i, t in rows) > 8
    assert periodic.collapse_runs(docs(spark, [])).count() == 0


def test_op13_on_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in table if len((r.text or "").split()) < 400}
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    assert len(got) == len(table)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in short.items():
        *want, runs, left = expected_runs(doc_id, text, True)
        assert got[doc_id] == (*want, digest(runs), digest(left))


# ---- vector codes


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 3, 400, 2**26]), st.integers(1, 256), st.integers(1, 17))
def test_nearest_is_brute_force(seed, most, entries, width):
    rng = np.random.default_rng(seed)
    book, queries = rng.integers(-most, most + 1, (entries, width)), rng.integers(-most, most + 1, (200, width))
    queries[:50] = book[rng.integers(0, entries, 50)]
    squares = ((queries[:, None] - book[None]) ** 2).sum(2)
    entry, square = vectorcodes.Gnat(book).nearest(queries)
    assert (entry == squares.argmin(1)).all() and (square == squares.min(1)).all()


def test_tree_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (30, 16))
    book = centres[rng.integers(0, 30, 256)] + rng.integers(-20, 20, (256, 16))
    queries = centres[rng.integers(0, 30, 500)] + rng.integers(-20, 20, (500, 16))
    looked, tree = [], vectorcodes.Gnat(book)
    measure = tree._measure
    tree._measure = lambda entries, asked, *rest: looked.append(len(entries) * len(asked)) or measure(entries, asked, *rest)
    tree.nearest(queries)
    assert sum(looked) < 0.4 * 500 * 256


def brute_codes(rows, dims):
    """(vec_id, code, error, label_error, digest) by whole distance tables."""
    fine = [(i, v, label) for i, v, label in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    whole = np.array([[int(np.floor(1024 * float(x))) for x in v] for _, v, _ in fine], np.int64)
    order = sorted(range(len(fine)), key=lambda k: (fine[k][0] is None, fine[k][0] or 0, whole[k].tolist()))[:256]
    width, codes, error, books = dims // 4, [""] * len(fine), [0] * len(fine), []
    for part in range(4):
        x = whole[:, part * width : (part + 1) * width]
        book = [x[k].tolist() for k in order]
        for r in range(5):
            squares = ((x[:, None] - np.array(book)[None]) ** 2).sum(2)
            best = squares.argmin(1)
            for e in range(len(book) if r < 4 else 0):
                if (best == e).any():
                    book[e] = [int(s) // int((best == e).sum()) for s in x[best == e].sum(0)]
        codes = [c + f"{b:02x}" for c, b in zip(codes, best)]
        error = [a + int(s) for a, s in zip(error, squares.min(1))]
        books += [c for entry in book for c in entry]
    labels = collections.Counter()
    for (_, _, label), e in zip(fine, error):
        labels[label] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return collections.Counter((i, c, e, labels[label], digest) for (i, _, label), c, e in zip(fine, codes, error))


@pytest.mark.parametrize("count", [5, 700])
def test_vector_codes(spark, count):
    rng = np.random.default_rng(count)
    rows = [(int(i), rng.normal(0, 0.2, 8).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(count)]
    rows += [(i, rows[0][1], None) for i in range(count, count + 60)]
    rows += [(900, None, 1), (901, [], 1), (902, [float("nan")] * 8, 1), (903, [0.5, None] * 4, 1), (904, [float("-inf")] * 8, 1)]
    rows += [(905, [1.0] * 4, 1), (906, [0.1] * 7, 1), (None, [0.25] * 8, None), (3, [0.5] * 8, 7), (3, [-0.5] * 8, 7), (3, [-0.5] * 8, 7)]
    rows += [(907, [1e30] + [0.0] * 7, 2)]
    schema = "vec_id long, embedding array<float>, label int, code string, error long, whole string, _x string"
    table = spark.createDataFrame([(*r, "x", 1, "x", "x") for r in rows], schema).repartition(5)
    got = collections.Counter(tuple(r) for r in vectorcodes.vector_codes(table).collect())
    assert got == brute_codes(rows[:-1], 8)
    assert vectorcodes.vector_codes(table.limit(0)).count() == 0


# ---- mixing


def mix_rows(seed, count=400):
    rnd = random.Random(seed)
    texts = prose(seed, count)
    return [(i, t, rnd.choice(["b", "b", "b", "b", "a", "c", "é", "", None])) for i, t in enumerate(texts)]


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * budget > 2 * sizes[s] * total}
        if not over:
            target |= {s: weight[s] * budget / total for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        budget -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("block_words", [7, 4096])
def test_mix(spark, monkeypatch, block_words):
    monkeypatch.setattr(mixing, "DOCS_TOGETHER", 50)
    monkeypatch.setattr(mixing, "SLOT_BITS", 4)
    rows = mix_rows(5) + [(1000, None, "b"), (1001, "", None), (1002, " \n", "a"), (1003, "w " * 3000, "c"), (None, "x y z", "b"), (7, "one", "b"), (7, "one", "b"), (1004, None, "empty source")]
    schema = "doc_id long, text string, source string, size long, target string, start string, slot string, rank string, words string"
    table = spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x") for r in rows], schema).repartition(7)
    mix = mixing.Mix(block_words=block_words)
    got = [tuple(r) for r in mixing.mix_report(table, mix).collect()]
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = brute_targets(sizes)
    inputs = collections.Counter((i, len((t or "").split()), sizes[s], round(want[s], 6)) for i, t, s in rows)
    assert collections.Counter((i, n, s, round(t, 6)) for i, n, s, t, _ in got) == inputs
    taken = collections.Counter()
    for _, size, source_size, target, words in got:
        assert 0 <= words <= 2 * size
        taken[source_size, round(target, 6)] += words
    for source, target in want.items():
        assert abs(taken[sizes[source], round(target, 6)] - target) <= 1
    assert collections.Counter(tuple(r) for r in mixing.mix_report(table.repartition(2), mix).collect()) == collections.Counter(got)

    listed = mixing.mixed(table, mix).collect()
    by_doc = collections.Counter()
    for r in listed:
        by_doc[r.doc_id] += r.n
    words = collections.Counter()
    for i, _, _, _, n in got:
        words[i] += n
    assert by_doc == +words
    if block_words == 7:
        # Every stretch of the schedule holds each source in proportion to its words.
        slots = collections.defaultdict(set)
        for r in listed:
            slots[r.source].add(r.slot)
        top = max(max(s) for s in slots.values())
        for found in slots.values():
            for share in (0.25, 0.5, 0.75):
                assert abs(sum(s <= share * top for s in found) - share * len(found)) <= 12
    assert mixing.mix_report(table.limit(0), mix).count() == 0
    nothing = mixing.mix_report(table.filter("text is null"), mix).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
