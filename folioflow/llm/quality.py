"""Quality rules as a short-circuit cascade, in built-in expressions only.

Every rule is a measure of the text and a test on it. On a bounded sample each
rule is run on its own: its time is its cost, the share of rows it rejects its
selectivity. The cascade tests the rules by rejected share per second, the best
first, in one CASE expression, so a rule's measure is computed only for rows that
all earlier rules have let through. The order has no influence on `kept`.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import let
from folioflow.session import kept as stored

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 8
# Rows that the order of the rules is estimated on. The verdicts don't depend on it.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000


def words(text: Column) -> Column:
    """Words of a text: runs of anything but the six ASCII spaces. Null has none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def word_chars(text: Column) -> Column:
    return F.length(_without(F.coalesce(text, F.lit("")), SPACES)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How often ASCII characters occur; bytes are counted, which is the same."""
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) - F.octet_length(_without(text, characters))).cast("long")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_repeat_words(text: Column) -> Column:
    """Words inside windows of eight words that the text holds twice or more.

    Windows are hashed; if none occurs twice, that is all. Else they are sorted
    with their places, those with an equal neighbour are repeated, and each covers
    eight words less what the next one covers again: no step is worse than a sort.
    """
    width = REPEAT_WIDTH

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - width
        return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        )

    def places(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        at = F.transform(ordered, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.array_sort(F.filter(at, lambda i: i.isNotNull()))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.coalesce(F.get(starts, k + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def repeated(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(let(ordered, places), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    return let(let(F.transform(words(text), lambda w: F.xxhash64(w)), windows), repeated)


@dataclass(frozen=True)
class Rule:
    """`measures` are computed from the text; `rejects` tests them, by name."""

    name: str
    measures: dict[str, object]
    rejects: object


def _n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def _exclamations(text: Column) -> Column:
    return count_of(text, "!")


def _symbols(text: Column) -> Column:
    return count_of(text, SYMBOLS)


BASE = (
    Rule("too_short", {"n_words": _n_words}, lambda m: m["n_words"] < 20),
    Rule(
        "repetitive",
        {"n_repeat_words": n_repeat_words, "n_words": _n_words},
        lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    ),
)
METHOD = (
    Rule("symbols", {"n_symbols": _symbols, "n_words": _n_words}, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("shouting", {"n_marks": _exclamations, "n_words": _n_words}, lambda m: 10 * m["n_marks"] > m["n_words"]),
    Rule(
        "same_lines",
        {"n_dup_lines": n_dup_lines, "n_lines": _n_lines},
        lambda m: (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    ),
    Rule(
        "word_length",
        {"word_chars": word_chars, "n_words": _n_words},
        lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"]),
    ),
)
RULES = BASE + METHOD


def _verdict(rule: Rule, text: Column) -> Column:
    return F.coalesce(rule.rejects({name: measure(text) for name, measure in rule.measures.items()}), F.lit(False))


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by share rejected per second of work, measured on the first `sample_rows` rows."""
    rows = docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).take(sample_rows)
    sample = stored(docs.sparkSession.createDataFrame(rows, "text string"))

    def timed(what: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rows = sample.agg(F.sum(what.cast("long"))).first()[0] or 0
        return time.perf_counter() - began, rows

    timed(F.col("text").isNull())
    idle, _ = timed(F.col("text").isNull())
    gains = []
    for rule in rules:
        seconds, rejected = timed(_verdict(rule, F.col("text")))
        gains.append((-(rejected + 0.5) / max(seconds - idle, 1e-3), rule.name, rule))
    return [rule for *_, rule in sorted(gains, key=lambda g: g[:2])]


def first_failed(text: Column, rules: list[Rule]) -> Column:
    """Name of the first rule in this order that rejects a text; null if none does."""
    first, *rest = rules
    chain = F.when(_verdict(first, text), F.lit(first.name))
    for rule in rest:
        chain = chain.when(_verdict(rule, text), F.lit(rule.name))
    return chain


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns.

    A null or empty text has no words and is rejected as too short; repeated rows
    are judged alike, each for itself; doc_id and other columns aren't looked at.
    """
    order = ordered_rules(docs, rules, sample_rows)
    return docs.filter(first_failed(docs["text"], order).isNull())


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, every measure, base_failed, first_failed (by cascade order) and kept.

    For a report all measures are wanted, so they are computed once each and the
    cascade runs on them.
    """
    order = ordered_rules(docs, rules, sample_rows)
    measures = {name: measure for rule in rules for name, measure in rule.measures.items()}
    text = F.col("text")

    def judged(m: Column) -> Column:
        rejected = [(rule.name, F.coalesce(rule.rejects(m), F.lit(False))) for rule in order]
        chain = F.when(rejected[0][1], F.lit(rejected[0][0]))
        for name, reject in rejected[1:]:
            chain = chain.when(reject, F.lit(name))
        base = [reject for name, reject in rejected if name in {rule.name for rule in BASE}]
        failed = reduce(lambda a, b: a | b, base, F.lit(False))
        return F.struct(*[m[name].alias(name) for name in measures], failed.alias("base_failed"), chain.alias("first_failed"))

    row = let(F.struct(*[measure(text).alias(name) for name, measure in measures.items()]), judged)
    return docs.select("doc_id", F.explode(F.array(row)).alias("_m")).select(
        "doc_id", "_m.*", F.col("_m.first_failed").isNull().alias("kept")
    )
