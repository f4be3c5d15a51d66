"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over a host's pages: elements in
order, each once, optional (?) or repeated (+), with text slots. Each page's
elements are first folded (neighbours that look alike become one repeated group),
then aligned with the wrapper so far: what matches is merged, what mismatches
becomes optional or a repeated group, text that differs becomes a slot. Merging
two wrappers is the same step, so tasks align the pages they read and only one
wrapper per host and task is shuffled, however many pages a host has.

The wrapper tells where the main text is: the article or main element if the host
has one, else the element into which most varying text falls; text in it that is
the same on all pages of a host is then furniture, unless all of it is: pages that
are copies of each other tell nothing.

Elements nested more than MAX_DEPTH deep are no elements of the wrapper: their text
belongs to the element at that depth, block by block. None of it is lost.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import kept

# Names that results depend on.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head script style title noscript template iframe object svg math canvas audio video form button select textarea input "
    "nav header footer aside dialog menu xmp".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"},
}
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|header|footer|"
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|disqus|respond|"
    r"replies|related|recommended|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
# Headings of an article and pieces of it that only sound like furniture.
HEADINGS = re.compile(
    r"(?:^|(?<=\s))(?:(?:article|content|entry|post|story)[_-]+header|(?!ad|promo|recommended|related|sponsor)[\w-]+[_-]story)(?=\s|$)", re.I
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|text|body)(?:$|[\s_-])", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|xmp|iframe|noscript)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?P<bad>/?[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
# Attributes are read one after another, so that nothing in a value is taken for a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MAX_DEPTH = 120
# Rules are sent with every task up to this size; larger ones are joined.
SENT_BYTES = 16 << 20
SALTS = 32
# Hosts whose wrappers a task holds before it passes them on.
HELD_HOSTS = 2000
RESULT = "page_id long, url string, text string"


def _label(tag: str, rest: str) -> tuple[str, bool]:
    """An element's label in the wrapper, and whether it is furniture."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
    names = " ".join(filter(None, (found.get("class"), found.get("id"))))
    role = (found.get("role") or "").lower()
    away = bool(
        tag in SKIPPED or role in ROLES or "hidden" in found or found.get("aria-hidden", "") == "true"
        or (names and tag not in ("html", "body", "article", "main") and FURNITURE.search(HEADINGS.sub("", names)))
    )
    label = ".".join([tag, *sorted(re.sub(r"\d+", "0", names).split())]) + (f"@{role}" if role else "")
    return label, away


def parse(page: str) -> list[tuple[str, object]]:
    """A page as events: ("open", (label, furniture)), ("close", None), ("text", decoded text), balanced."""
    events: list[tuple[str, object]] = []
    # Block elements only: inline ones neither break blocks nor close anything.
    stack: list[str] = []
    opened: Counter[str] = Counter()

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()] -= 1
            events.append(("close", None))

    def open_(tag: str, rest: str) -> None:
        if tag in INLINE:
            if tag == "br":
                events.append(("text", " "))
            return
        if stack and (stack[-1] == "p" or stack[-1] in CLOSES.get(tag, ())):
            close_to(len(stack) - 1)
        events.append(("open", _label(tag, rest)))
        if tag in VOID:
            events.append(("close", None))
        else:
            stack.append(tag)
            opened[tag] += 1

    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at:
            events.append(("text", html.unescape(page[at : match.start()])))
        at = match.end()
        tag = (match["tag"] or match["bad"] or "").lower()
        if not tag:
            continue
        if match["end"] or tag.startswith("/"):
            tag = tag.lstrip("/")
            if opened[tag]:
                while stack[-1] != tag:
                    close_to(len(stack) - 1)
                close_to(len(stack) - 1)
        else:
            open_(tag, match["rest"] or "")
    if at < len(page):
        events.append(("text", html.unescape(page[at:])))
    close_to(0)
    return events


def node(label: str, away: bool) -> dict:
    """A wrapper element: pages that have it, repeated, furniture, characters of text, constant text's hash, elements inside."""
    return {"l": label, "n": 1, "m": False, "a": away, "c": 0, "t": "", "k": []}


def _digest(text: str) -> str:
    """What tells a text from others, white space aside: only whether it is the same is needed of it."""
    words = " ".join(text.split())
    return xxhash.xxh3_128_hexdigest(words) if words else ""


def merged(a: dict, b: dict, same_page: bool = False) -> dict:
    """Two elements as one; on the same page they make a repeated group."""
    return {
        "l": a["l"], "n": a["n"] if same_page else a["n"] + b["n"], "m": a["m"] or b["m"] or same_page, "a": a["a"] and b["a"],
        "c": a["c"] + b["c"], "t": a["t"] if a["t"] == b["t"] else None, "k": aligned(a["k"], b["k"], same_page),
    }


def folded(kids: list[dict]) -> list[dict]:
    """Repeated neighbours, one or several elements long, as one group each."""
    for width in range(1, 5):
        out, at = [], 0
        while at < len(kids):
            group, after = kids[at : at + width], at + width
            names = [k["l"] for k in group]
            while len(group) == width and [k["l"] for k in kids[after : after + width]] == names:
                group = [merged(a, b, True) for a, b in zip(group, kids[after : after + width])]
                after += width
            if after > at + width:
                out += group
                at = after
            else:
                out.append(kids[at])
                at += 1
        kids = out
    return kids


def aligned(a: list[dict], b: list[dict], same_page: bool = False) -> list[dict]:
    """Two rows of elements as one: a longest common row is merged, the rest becomes optional."""
    la, lb = [k["l"] for k in a], [k["l"] for k in b]
    if la == lb:
        return [merged(x, y, same_page) if not same_page else _joined(x, y) for x, y in zip(a, b)]
    longest = CommonRow(la, lb)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if la[i] == lb[j]:
            out.append(_joined(a[i], b[j]) if same_page else merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif longest.without(i, j):
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return folded(out + a[i:] + b[j:])


class CommonRow:
    """Which elements a longest common row can do without, for walks over `a` and `b` in order.

    Of the table of lengths, each line is one integer: a bit is 0 where the line
    grows. Lines are made from the end of `a`, a word of bits at a time; of every
    few one is held, and those between are made again when the walk gets there.
    """

    def __init__(self, a: list[str], b: list[str]):
        known_a, known_b = set(a), set(b)
        self._a = [label for label in reversed(a) if label in known_b]
        kept_b = [label for label in reversed(b) if label in known_a]
        # How many of the labels that both have come at a place or later.
        self._left_a, self._left_b = _still(a, known_b), _still(b, known_a)
        places: dict[str, list[int]] = {}
        for j, label in enumerate(kept_b):
            places.setdefault(label, []).append(j)
        self._where = {label: _bits(at, len(kept_b)) for label, at in places.items()}
        self._full = (1 << len(kept_b)) - 1
        self._step = isqrt(len(self._a)) + 1
        self._held = [self._full]
        line = self._full
        for i, label in enumerate(self._a, 1):
            line = self._next(line, label)
            if i % self._step == 0:
                self._held.append(line)
        self._block, self._lines = -1, []

    def _next(self, line: int, label: str) -> int:
        hit = line & self._where[label]
        return (line + hit | line - hit) & self._full

    def _line(self, n: int) -> int:
        block, at = divmod(n, self._step)
        if block != self._block:
            self._block, self._lines = block, [self._held[block]]
            for label in self._a[block * self._step : (block + 1) * self._step - 1]:
                self._lines.append(self._next(self._lines[-1], label))
        return self._lines[at]

    def without(self, i: int, j: int) -> bool:
        """Whether the rows from `i` and `j` on have a common row as long without element `i`."""
        n = self._left_a[i]
        if n == self._left_a[i + 1]:
            return True
        mask = (1 << self._left_b[j]) - 1
        return (self._line(n) & mask).bit_count() == (self._line(n - 1) & mask).bit_count()


def _still(labels: list[str], known: set[str]) -> list[int]:
    left = [0]
    for label in reversed(labels):
        left.append(left[-1] + (label in known))
    return left[::-1]


def _bits(places: list[int], size: int) -> int:
    data = bytearray(size // 8 + 1)
    for at in places:
        data[at >> 3] |= 1 << (at & 7)
    return int.from_bytes(data, "little")


def _joined(a: dict, b: dict) -> dict:
    """Elements inside a repeated group: on one page, but not neighbours."""
    return merged(a, b, True) | {"m": a["m"] or b["m"]}


def page_wrapper(events: list[tuple[str, object]]) -> dict:
    """The wrapper of one page."""
    root = node("", False)
    stack: list[tuple[dict, list[str], list[str]]] = [(root, [], [])]
    # Elements too deep for the wrapper, whether each is furniture.
    below: list[bool] = []
    for kind, value in events:
        if kind == "open":
            if len(stack) > MAX_DEPTH:
                below.append(bool(value[1]))
            else:
                stack.append((node(*value), [], []))
        elif kind == "close":
            if below:
                below.pop()
                continue
            done, own, deep = stack.pop()
            text = "".join(own)
            done["c"] = len(" ".join(text.split())) + len(" ".join("".join(deep).split()))
            done["t"] = _digest(text)
            done["k"] = folded(done["k"])
            stack[-1][0]["k"].append(done)
        elif not below:
            stack[-1][1].append(value)
        elif not any(below):
            stack[-1][2].append(value)
    root["k"] = folded(root["k"])
    return root


def _constant(element: dict) -> bool:
    """Whether an element's own text is the same on all pages that have it."""
    return element["t"] is not None and element["n"] > 2 and not element["m"]


def _size(element: dict) -> int:
    """Characters of varying text in an element, furniture aside."""
    if element["a"]:
        return 0
    return (0 if _constant(element) else element["c"]) + sum(map(_size, element["k"]))


def rules(wrapper: dict) -> dict:
    """{"take": paths of the main text, "drop": [path, hash] of constant texts}, paths as lists of labels."""

    def found(element: dict, path: list[str], test) -> list[tuple[int, list[str]]]:
        if element["a"]:
            return []
        if test(element):
            return [(_size(element), path)]
        return [x for kid in element["k"] for x in found(kid, [*path, kid["l"]], test)]

    def constant(element: dict, path: list[str]) -> list[tuple[list[str], str]]:
        own = [(path, element["t"])] if element["t"] and _constant(element) else []
        return own + [x for kid in element["k"] for x in constant(kid, [*path, kid["l"]])]

    named = found(wrapper, [], lambda e: re.match(r"(article|main)\b|.*@main$|.*@article$", e["l"]))
    if named:
        return {"take": [path for _, path in named], "drop": constant(wrapper, []) if any(size for size, _ in named) else []}
    total = _size(wrapper)
    named = found(wrapper, [], lambda e: e["l"].split(".")[0] not in ("", "html", "body") and CONTENT.search(e["l"].replace(".", " ")))
    best = max(named, key=lambda x: x[0], default=(0, []))
    if not best[0] or 2 * best[0] < total:
        path, element = [], wrapper
        while True:
            kids = [k for k in element["k"] if 5 * _size(k) >= 4 * max(_size(element), 1) and k["k"]]
            if not kids:
                break
            element = kids[0]
            path = [*path, element["l"]]
        best = (total, path)

    return {"take": [best[1]], "drop": constant(wrapper, []) if total else []}


def main_text(events: list[tuple[str, object]], rule: dict) -> str | None:
    """The blocks of a page's main text by a host's rules; None if the page has no such place."""
    take = {tuple(p) for p in rule["take"]}
    drop = {(tuple(p), text) for p, text in rule["drop"]}
    places = {p for p, _ in drop}
    blocks: list[str] = []
    path: list[str] = []
    # Of each open element: its own text, and where that is in the blocks.
    owns: list[tuple[list[str], list[int]]] = [([], [])]
    inside = int(() in take)
    away = 0
    waiting: list[str] = []
    states: list[tuple[int, int]] = []
    met = bool(inside)

    def flush() -> None:
        own, at = owns[-1]
        own += waiting
        if inside and not away:
            text = " ".join("".join(waiting).split())
            if text:
                at.append(len(blocks))
                blocks.append(text)
        waiting.clear()

    for kind, value in events:
        if kind == "text":
            waiting.append(value)
            continue
        flush()
        if kind == "open":
            label, furniture = value
            states.append((inside, away))
            owns.append(([], []))
            if len(states) <= MAX_DEPTH:
                path.append(label)
                if tuple(path) in take:
                    inside, met = 1, True
            away += furniture
        else:
            own, at = owns.pop()
            if len(states) <= MAX_DEPTH:
                place = tuple(path)
                # A constant text goes, the elements inside its element stay.
                if at and place in places and (place, _digest("".join(own))) in drop:
                    for i in at:
                        blocks[i] = ""
                path.pop()
            inside, away = states.pop()
    flush()
    return "\n".join(filter(None, blocks)) if met else None


def _host() -> Column:
    host = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(host)


def _wrapper_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict] = {}

    def flush() -> pa.RecordBatch:
        rows = [(host, json.dumps(w)) for host, w in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if page:
                own = page_wrapper(parse(page))
                held[host] = merged(held[host], own) if host in held else own
                if len(held) > HELD_HOSTS:
                    yield flush()
    if held:
        yield flush()


def _rule_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per host; rows come sorted by host."""
    host, wrapper = None, None
    done: list[tuple[str, str]] = []
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = json.loads(text)
            if name == host:
                wrapper = merged(wrapper, own)
            else:
                if wrapper is not None:
                    done.append((host, json.dumps(rules(wrapper))))
                host, wrapper = name, own
    if wrapper is not None:
        done.append((host, json.dumps(rules(wrapper))))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["host", "rule"])


def host_rules(pages: DataFrame) -> DataFrame:
    """(host, rule): the wrapper's rules of every host, from all of its pages."""
    each = pages.select(_host().alias("host"), "html").mapInArrow(_wrapper_rows, "host string, wrapper string")
    return each.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_rule_rows, "host string, rule string")


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for page, rule in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if not page:
                texts.append("")
                continue
            events = parse(page)
            if rule not in known:
                if len(known) > HELD_HOSTS:
                    known.clear()
                known[rule] = json.loads(rule)
            text = main_text(events, known[rule])
            if text is None:  # a page unlike its host's others
                text = main_text(events, rules(page_wrapper(events)))
            texts.append(text or "")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of every row of (page_id, url, html).

    Blocks come in page order, one a line, white space inside as one space. A null
    or empty html gives an empty text; pages with a null or odd url share one
    wrapper; repeated rows and page_ids are extracted each by itself; pages may be
    nested to any depth; other columns are not read.
    """
    found = kept(host_rules(pages))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", _host().alias("host"))
    size = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("rule") + 32), F.lit(0))).first()[0]
    if size <= SENT_BYTES:
        met = rows.join(F.broadcast(found), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        many = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = rows.withColumn("salt", salt).join(many, ["host", "salt"], "left")
    nothing = F.lit(json.dumps({"take": [], "drop": []}))
    return met.select("page_id", "url", "html", F.coalesce("rule", nothing).alias("rule")).mapInArrow(_text_rows, RESULT)
