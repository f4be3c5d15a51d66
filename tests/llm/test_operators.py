"""Operators of the llm subpackage against brute force, and on odd rows."""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import bpe, decontaminate, jaccard, phrases, pii, quality, repeats, simple8b, warc, wrappers

BPE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, _text string, ids string, words string, row string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)


def prose(seed, count, words=60):
    rnd = random.Random(seed)
    vocabulary = ["w" + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 2 * words))) for _ in range(count)]


@pytest.fixture(scope="module")
def odd_rows():
    base = prose(1, 12)
    long = " ".join(prose(2, 40))
    passage = " ".join(f"shared{i}" for i in range(90))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, base[1] + " tail"), (23, None), (24, ""), (25, " \n\t "), (26, "one"), (27, long)]
    rows += [(28, "a b " * 400), (29, f"x1 x2 {passage} y1"), (30, f"z1 {passage} z2 z3"), (31, long + " end"), (32, "é" * 500)]
    return rows + [(None, base[2]), (None, None), (33, "same id"), (33, base[3]), (33, base[3])]


def test_bpe_is_the_library(spark, odd_rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_documents(docs(spark, odd_rows), BPE, PATTERN)
    got = [(r.doc_id, bytes(r.ids), bytes(r.data)) for r in bpe.decode_documents(encoded, BPE, PATTERN).collect()]
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in odd_rows]
    assert collections.Counter(got) == collections.Counter(want)
    once = bpe.round_trip(docs(spark, odd_rows), BPE, PATTERN, "words")
    assert once.columns == ["doc_id", "ids", "words", "data"]
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.data)) for r in once.collect()) == collections.Counter(want)
    assert bpe.round_trip(docs(spark, []), BPE, PATTERN).count() == 0
    own = bpe.codec(BPE, PATTERN)
    rnd = random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choice("abc  \n\t'sStT.,é　\x1c\x85\xa01!#中😀") for _ in range(rnd.randrange(30)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    piece = "ab" * 30_000
    assert np.frombuffer(own.encode(piece), "<u4").tolist() == library.encode_ordinary(piece)


def test_pre_tokens_share_a_queue():
    """Whatever the order of ranks and the gaps in them, each pre-token is merged as if alone."""
    rnd = random.Random(4)

    def alone(piece, ranks):
        parts = [piece] if piece in ranks else [bytes([b]) for b in piece]
        while True:
            found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not found:
                return [ranks[x] for x in parts]
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    for _ in range(60):
        tokens = {bytes([c]) for c in b"abc\0"}
        for _ in range(rnd.randrange(1, 30)):
            tokens.add(rnd.choice(sorted(tokens)) + rnd.choice(sorted(tokens)))
        order = rnd.sample(sorted(tokens), len(tokens))
        ranks = {token: i * 97 for i, token in enumerate(order)}
        levels = bpe.no_ranks(max(ranks.values()) + 1)
        pieces = [bytes(rnd.choice(b"abc\0") for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
        for _ in range(2):
            got = [np.frombuffer(ids, "<u4").tolist() for ids in bpe.merge_all(pieces, ranks, levels)]
            assert got == [alone(piece, ranks) for piece in pieces]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    block = np.array(values, np.uint64)
    assert (simple8b.decode_block(simple8b.encode_block(block), len(block)) == block).all()


def test_id_files(spark, odd_rows):
    library = Tokenizer.from_file(WORDS)
    special = "a <|endoftext|> b|H\u0331ello x|<|ENDOFTEXT|>|x<|endoftext|>, y.|<|endoftext|>.|É e\u0301 E\u0301,|a\u00a0b. C\u2028D|ǅ İ ß. ſ,".replace("|endoftext|", "\0").replace("|ENDOFTEXT|", "\1").split("|")
    special = [t.replace("\0", "|endoftext|").replace("\1", "|ENDOFTEXT|") for t in special]
    special += [f"a {token.content} b{token.content}. {token.content.upper()}" for token in library.get_added_tokens_decoder().values()]
    odd_rows = odd_rows + [(700 + i, t) for i, t in enumerate(special)]
    got = simple8b.read_ids(simple8b.write_ids(docs(spark, odd_rows), WORDS)).collect()
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, t in odd_rows]
    want = collections.Counter(zip([i for i, _ in odd_rows], ids))
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert simple8b.read_ids(simple8b.write_ids(docs(spark, []), WORDS)).count() == 0


def test_quality(spark, odd_rows):
    report = quality.quality_report(docs(spark, odd_rows)).collect()

    def brute(text):
        words = (text or "").encode().split()
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(words), sum(len(w.decode()) for w in words), len(inside)

    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_repeat_words) for r in report)
    assert got == collections.Counter((i, *brute(t)) for i, t in odd_rows)
    kept = quality.quality_cascade(docs(spark, odd_rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert kept.count() == sum(r.kept for r in report)
    assert quality.quality_report(docs(spark, [])).count() == 0


def test_phrases(spark, odd_rows):
    first = {}
    for doc_id, text in odd_rows:
        words = (text or "").encode().split()
        if doc_id is not None:
            for i in range(len(words) - 12):
                key = tuple(words[i : i + 13])
                first[key] = min(doc_id, first.get(key, doc_id))
    want = collections.Counter()
    for doc_id, text in odd_rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - 12):
            if doc_id is not None and first[tuple(words[i : i + 13])] < doc_id:
                gone |= set(range(i, i + 13))
        want[doc_id, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()] += 1
    got = phrases.remove_repeated_phrases(docs(spark, odd_rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert phrases.remove_repeated_phrases(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot_runs", [1000, 1])
def test_repeats(spark, odd_rows, hot_runs):
    counts = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in odd_rows]
    for _, data in texts:
        counts.update(data[i : i + 400] for i in range(len(data) - 399))
    want = collections.Counter()
    for doc_id, data in texts:
        gone, end, spans = bytearray(len(data)), -1, 0
        for i in range(len(data) - 399):
            if counts[data[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
                spans += i > end
                end = i + 400
        want[doc_id, len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone) if not g)] += 1
    got = repeats.remove_repeats(docs(spark, odd_rows), hot_runs=hot_runs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_maximal_repeats_have_all_occurrences():
    text = b"xxabcabcabcyyabcabczz"
    found = {length: sorted(at) for length, at in repeats.maximal_repeats([(text, len(text) - 2)], width=3)}
    assert found[6] == [(0, 2), (0, 5), (0, 13)]
    assert found[3] == [(0, 2), (0, 5), (0, 8), (0, 13), (0, 16)]


def covered_bytes(runs, width):
    """The bytes of each run that maximal repeats cover, and those that brute force finds."""
    counts = collections.Counter(text[i : i + width] for text, starts in runs for i in range(starts))
    want = [{j for i in range(starts) if counts[text[i : i + width]] > 1 for j in range(i, i + width)} for text, starts in runs]
    got = [set() for _ in runs]
    for length, places in repeats.maximal_repeats(runs, width):
        assert len({runs[run][0][at : at + length] for run, at in places}) == 1
        for run, at in places:
            got[run] |= set(range(at, at + length))
    return got, want


def test_maximal_repeats_are_whole():
    rnd = random.Random(4)
    fresh = lambda size: bytes(rnd.randrange(97, 123) for _ in range(size))
    shared = fresh(2000)
    long = [b"x" + shared[:700] + b"1", b"y" + shared[:560] + b"2" + fresh(139), b"z" + shared[:700] + b"3"]
    line = b"the line that comes again, always the same.\n"
    lines = b"".join(line + fresh(20) for _ in range(40))[:2000]
    cases = [[long[i] for i in order] for order in itertools.permutations(range(3))]
    cases += [[b"x" + shared, b"y" + shared], [b"x" + lines, b"y" + lines, lines[:1500]], [b"a" * 500, b"a" * 900, b"a" * 700]]
    # The first text's end and the second one's start together are what the last two share.
    cases.append([b"x" + shared[:500], shared[500:1300], b"y" + shared[:900], b"z" + shared[:900]])
    for texts in cases:
        got, want = covered_bytes([(t, len(t) - 399) for t in texts], 400)
        assert got == want
    for _ in range(300):
        pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 30))) for _ in range(3)]
        texts = [b"".join(rnd.choices(pieces, k=rnd.randrange(1, 6))) + b"ccc" for _ in range(rnd.randrange(1, 6))]
        got, want = covered_bytes([(t, len(t) - 3) for t in texts], 4)
        assert got == want


def test_suffix_order():
    rnd = random.Random(9)
    for round_ in range(60):
        texts = [[rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))] * rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 6))]
        data = np.array([x for i, text in enumerate(texts) for x in (*text, 256 + i)], np.int32)
        wanted = np.array([i for i in range(len(data)) if data[i] < 256 and (round_ % 2 or rnd.random() < 0.7)], np.int64)
        order, common = repeats.suffix_order(data, wanted)
        assert sorted(order.tolist()) == wanted.tolist()
        for i in range(1, len(order)):
            one, two = data[order[i - 1] :].tolist(), data[order[i] :].tolist()
            assert common[i] == next(k for k, (x, y) in enumerate(zip(one, two)) if x != y)
        # What shares more with a place stands nearer to it, on each side.
        for i in range(len(order)):
            shares = [next((k for k, (x, y) in enumerate(zip(data[order[i] :], data[o:])) if x != y), len(data)) for o in order]
            assert shares[i:] == sorted(shares[i:], reverse=True) and shares[:i] == sorted(shares[:i])


def test_shared_stretches_hold_every_repeat():
    rnd = random.Random(10)
    fresh = lambda size: bytes(rnd.randrange(97, 123) for _ in range(size))
    shared = fresh(500)
    texts = [b"x" + shared[:450], fresh(600), shared[50:] + fresh(10), shared[:399] + b"!", b"", b"short"]
    found = repeats.shared_stretches([np.frombuffer(t, np.uint8) for t in texts], 400)
    assert found == [(0, 1, 451), (2, 0, 400)]
    ((length, places),) = repeats.maximal_repeats([(t, max(len(t) - 399, 0)) for t in texts])
    assert length == 400 and sorted(places) == [(0, 51), (2, 0)]
    assert repeats.maximal_repeats([]) == [] and repeats.maximal_repeats([(b"", 0)]) == []


def test_long_repeats(spark):
    rnd = random.Random(6)
    fresh = lambda size: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size))
    rows = []
    for _ in range(30):
        shared = fresh(700)
        rows += [(len(rows) + i, f"{i}{shared[:size]}{fresh(200)}") for i, size in enumerate((700, 560, 700))]
    lines = "".join("the line that comes again, always the same.\n" + fresh(20) for _ in range(40))[:2000]
    rows += [(900, "x" + lines + fresh(300)), (901, "y" + lines + fresh(400))]
    counts = collections.Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    want = {n: len({j for i in range(len(t) - 399) if counts[t[i : i + 400]] > 1 for j in range(i, i + 400)}) for n, t in rows}
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs(spark, rows)).collect()} == want


def components(rows, width, percent):
    sets, home = collections.defaultdict(list), {}

    def root(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
        sets[doc_id].append(grams)
    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                home[high] = low
    return collections.Counter((i, len(s), None if i is None else root(i)) for i in sets for s in sets[i])


@pytest.mark.parametrize(("block_docs", "block_shingles"), [(1000, 10**6), (5, 10**6), (1000, 300)])
def test_jaccard(spark, odd_rows, block_docs, block_shingles):
    rnd = random.Random(5)
    base = prose(7, 1, 80)[0].split() * 2
    near = []
    for i in range(40):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = f"new{i}"
        near.append((100 + i, " ".join(words)))
    rows = odd_rows + near
    got = jaccard.jaccard_components(docs(spark, rows), 4, 85, block_docs, block_shingles).collect()
    assert collections.Counter(tuple(r) for r in got) == components(rows, 4, 85)
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_decontamination(spark, odd_rows):
    item = " ".join(f"word{i}" for i in range(30))
    cut = " ".join(f"Word{i}," for i in range(2, 30))
    rows = odd_rows + [(200, f"before it {item} after"), (201, cut), (202, " ".join(f"word{i}" for i in range(0, 30, 2)))]
    rows += [(203, item.replace("word15", "other"))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "a b"), (4, item), (None, item)], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d in (200, 201) for i in (1, 4)}
    assert {r.start for r in found if r.doc_id == 200} == {2}
    assert decontaminate.clean_documents(docs(spark, rows), bench).count() == len(rows) - 2
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def test_warc(spark):
    page = "<p>" + "x" * 50
    rows = [(1, "http://b.example/x", page), (2, "http://a.example/", page), (3, None, None), (4, "not a url", ""), (5, "http://a.example/?q=1", "é")]
    rows += [(2, "http://a.example/", page), (None, "http://c.example/", page), (None, "http://c.example:80x/", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shards = warc.capture(pages, block_lines=2)
    got = collections.Counter((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_archives(shards).collect())
    want = collections.Counter()
    for page_id, url, html in rows:
        data = (html or "").encode()
        owner = max([r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None], default=None)
        first = page_id == owner
        want[page_id, url, "response" if first else "revisit", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), None if first else owner] += 1
    assert got == want
    urls = spark.createDataFrame([("http://a.example/",), ("http://nowhere.example/",)], "url string")
    assert [r.page_id for r in warc.read_records(warc.lookup(shards, urls)).collect()] == [2, 2]
    assert warc.read_archives(warc.capture(pages.limit(0))).count() == 0


def test_pseudonyms(spark, odd_rows):
    key = b"k"
    values = ["4111111111111111", "5500 0055 5555 5559", "und.34@mail7.example.com", "+1 (017) 555-7713", "233.254.104.120", "2024-02-29", "31.12.1999", "DE89370400440532013000"]
    # A wrong check digit, a time stamp, a book number, no issuer of cards.
    for value in ("9807915762804490", "1700000000123", "978-3-16-148410-0", "9780306406157", "4111111111111112", "7992739871300005"):
        assert pii.pseudonymise(f"before {value} after.", key) == (f"before {value} after.", 0)
    for value in values:
        new, count = pii.pseudonymise(f"before {value} after.", key)
        assert count == 1 and value not in new and len(new.split()) == len(f"before {value} after.".split())
        assert pii.pseudonymise(new, key, back=True)[0] == f"before {value} after."
        assert pii.pseudonymise(f"x {value}!", key)[0][2:-1] == new[len("before ") : -len(" after.")]
    card = pii.pseudonym("card", "4111111111111111", key)
    assert pii.luhn_digit(card[:-1]) == card[-1]
    assert pii.pseudonymise("2023-02-30 and 300.1.1.1", key) == ("2023-02-30 and 300.1.1.1", 0)
    assert sorted(pii.feistel(n, 1000, key, b"t") for n in range(1000)) == list(range(1000))
    got = pii.pseudonymised(docs(spark, odd_rows), "k").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(odd_rows)


def test_ssn_is_validated():
    for text in ("000-12-3456", "666-12-3456", "900-12-3456", "999-99-9999", "123-00-4567", "123-45-0000"):
        assert pii.pseudonymise(f"before {text} after", b"k") == (f"before {text} after", 0)
    rnd = random.Random(8)
    values = ["001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999"]
    values += [f"{rnd.randrange(1, 666):03d}-{rnd.randrange(1, 100):02d}-{rnd.randrange(1, 10000):04d}" for _ in range(2000)]
    for text in values:
        new = pii.pseudonym("ssn", text, b"k")
        area, group, serial = new.split("-")
        assert (len(area), len(group), len(serial)) == (3, 2, 4)
        assert 0 < int(area) < 900 and area != "666" and int(group) and int(serial)
        assert pii.pseudonym("ssn", new, b"k", back=True) == text


def test_wrappers(spark):
    def page(i, extra=""):
        return (
            f"<html><head><title>t{i}</title><script>if (a<b) x()</script></head><body><div class='top-menu'><ul><li>m{i}</ul></div>"
            f"<div class=wrap><h2>Title {i}</h2><p>Text <i>{i}</i> &amp; more<br>of&nbsp;it<p>Second {i}{extra}</div>"
            f"<div id=comments><p>c{i}</div><p>Fixed line.</p><footer>f{i}</footer></body></html>"
        )

    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(6)]
    rows += [(10, "http://two.example/", "<article><h1>A</h1><nav>n</nav><p>b"), (11, None, "plain text"), (12, "http://x/", None), (13, "?", ""), (10, "http://two.example/", "<main>z")]
    got = collections.Counter((r.page_id, r.text) for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = collections.Counter((i, f"Title {i}\nText {i} & more of it\nSecond {i}") for i in range(6))
    want.update([(10, "A\nb"), (11, "plain text"), (12, ""), (13, ""), (10, "z")])
    assert got == want


def texts_of(pages):
    """The texts of one host's pages."""
    events = [wrappers.parse(page) for page in pages]
    wrapper = functools.reduce(wrappers.merged, map(wrappers.page_wrapper, events))
    return [wrappers.main_text(e, wrappers.rules(wrapper)) for e in events]


def test_constant_text_leaves_what_is_inside():
    skip = "<body><a href=#c>Skip to content</a><div class=content><p>Article {0} on {0}</p></div>"
    assert texts_of(skip.format(i) for i in range(4)) == [f"Article {i} on {i}" for i in range(4)]
    staff = "<body><div class=content>By staff<p>Article {0} on {0}</p>, all rights<table><tr><td>Price: <p>{0}</p></table></div>"
    assert texts_of(staff.format(i) for i in range(4)) == [f"Article {i} on {i}\n{i}" for i in range(4)]
    # One of two elements of the same path is constant.
    two = "<body><div class=content><p>Fixed line.</p><h2>Title {0}</h2><p>Article {0} on {0}</p></div>"
    assert texts_of(two.format(i) for i in range(4)) == [f"Title {i}\nArticle {i} on {i}" for i in range(4)]


def test_hidden_is_an_attribute_of_its_own():
    shown = ['style="overflow:hidden"', "style='x: hidden; y'", 'data-hidden="false"', 'title="hidden gems"', 'title="a > b" data-id="menu"', "alt=not-hidden", "data-role=search", "href=/a/hidden/b"]
    for rest in shown:
        assert texts_of([f"<body><div {rest}><p>One</p></div>"]) == ["One"]
        assert wrappers._label("div", " " + rest) == ("div", False)
    for rest in ("hidden", "HIDDEN", 'hidden=""', "class=a hidden", 'title="x"hidden', "aria-hidden=true", 'Role = "search"', "class='a menu'"):
        assert wrappers._label("div", " " + rest)[1]
    assert wrappers._label("div", ' data-x="1" CLASS=b2 id="a"/') == ("div.a.b0", False)


def test_common_rows():
    rnd = random.Random(12)
    for _ in range(300):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randrange(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        row = wrappers.CommonRow(a, b)
        for i in range(len(a)):
            assert [row.without(i, j) for j in range(len(b))] == [best[i][j] == best[i + 1][j] for j in range(len(b))]


def test_odd_pages():
    for depth in (100, 1000, 100_000):
        deep = "<body>" + "<div class=content>" * depth + "One <b>{0}</b><p>Two {0}</p><div class=menu>m<div>n</div></div>Three"
        assert texts_of(deep.format(i) for i in range(2)) == [f"One {i}\nTwo {i}\nThree" for i in range(2)]
    many = lambda x: "".join(f"<div id='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{x}'>{i}</div>" for i in range(15_000))
    pages = [f"<main>{many(x)}<p>last</main>" for x in "xy"]
    assert [len(t.split("\n")) for t in texts_of(pages)] == [15_001] * 2
    assert texts_of(["<main>" + "<b>" * 100_000 + "x" + "<hr>" * 100_000 + "</i>" * 100_000 + "</ul>" * 100_000]) == ["x"]


def test_headings_that_sound_like_furniture():
    page = "<main><div class='entry-header'><h1>Title {0}</h1></div><div class='notice-board-story'>Text {0}</div><div class='related-story'>r</div><div class='site-header'>s</div></main>"
    assert texts_of(page.format(i) for i in range(4)) == [f"Title {i}\nText {i}" for i in range(4)]


def test_long_constant_text_is_furniture():
    notice = "This notice is the same on every page. " * 12
    for tag in ("div class=content", "article", "main"):
        page = f"<body><{tag}><h1>Title {{0}}</h1><div class=x>{notice}</div><p>Article {{0}} on {{0}}</p></{tag.split()[0]}>"
        assert texts_of(page.format(i) for i in range(4)) == [f"Title {i}\nArticle {i} on {i}" for i in range(4)]
        # Copies of one page, and two pages, do not tell what is furniture.
        assert texts_of([page.format(7)] * 4) == [f"Title 7\n{notice.strip()}\nArticle 7 on 7"] * 4
        assert texts_of(page.format(i) for i in range(2)) == [f"Title {i}\n{notice.strip()}\nArticle {i} on {i}" for i in range(2)]
    # A long notice does not weigh in where the main text is looked for.
    page = f"<body><div class=side>{notice}</div><div class=mid><h2>Title {{0}}</h2><p>Article {{0}} on {{0}}</p></div>"
    assert texts_of(page.format(i) for i in range(4)) == [f"Title {i}\nArticle {i} on {i}" for i in range(4)]
    varying = [f"<body><div class=content><p>{notice}</p><p>{notice}{i}</p></div>" for i in range(4)]
    assert [t.endswith(f"every page. {i}") for i, t in enumerate(texts_of(varying))] == [True] * 4


def test_pipeline(spark, tmp_path, odd_rows):
    import corpus_pipeline

    item = " ".join(f"word{i}" for i in range(30))
    card = "The number 4111111111111111 is here"
    rows = [r for r in odd_rows if r[0] is not None] + [(300, f"some words {item} " + prose(9, 1)[0]), (301, f"{card} {prose(10, 1)[0]} {prose(11, 1)[0]}")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert all(r.decoded_ok for r in out.values())
    assert 300 not in out and 301 in out and not {20, 21, 23, 24, 25, 26, 28} & set(out)
    assert b"4111111111111111" not in bpe.codec(BPE, PATTERN).decode(np.frombuffer(out[301].ids, "<u4"))


def test_rows_of_one_doc_id(spark):
    import corpus_pipeline

    texts = prose(12, 4)
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[2]), (3, texts[2])]
    rows += [(None, texts[3]), (None, texts[3]), (4, None), (4, None), (5, None)]
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs(spark, rows), "").collect())
    want = {(1, texts[0]): 1, (3, texts[1]): 1, (3, texts[2]): 1, (None, texts[3]): 2, (4, None): 1, (5, None): 1}
    assert got == want


def test_crc_matches(spark):
    data = np.arange(5, dtype="<u4").tobytes()
    assert spark.createDataFrame([(bytearray(data),)], "ids binary").selectExpr("crc32(ids)").first()[0] == zlib.crc32(data)


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(1, 600), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.append(base[rng.random(len(base)) > 0.07], base[:1])), np.unique(base[: len(base) // 2 + 1])]
    near = jaccard.may_link(np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets], 85)
    for i, one in enumerate(sets):
        shared = [len(np.intersect1d(one, other)) for other in sets]
        linked = any(100 * n >= 85 * (len(one) + len(o) - n) for j, (n, o) in enumerate(zip(shared, sets)) if j != i)
        assert near[i] or not linked
    alone = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(30)]
    assert not jaccard.may_link(np.full(30, 300), [jaccard.bitmap(s) for s in alone], 85).any()
