"""Where each hunk belongs in its target file."""

from __future__ import annotations

import difflib
from collections import Counter
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.defaults import MAX_DISTANCE, RATIO_EPSILON
from folioflow.functions.hunks import original_lines, pure_addition
from folioflow.functions.text import is_blank, let, normalize_line, once, sha1_content, split_lines, strip
from folioflow.operators.lineindex import (
    described,
    file_index,
    file_lines,
    identified,
    numbered_lines,
    piece_places,
    places,
    with_file,
    with_probe,
)
from folioflow.operators.selection import KEY
from folioflow.operators.skew import key_counts, only_named, skew_join
from folioflow.session import kept

HUNK_ID = ["response_id", "hunk_pos"]


def hunks_with_file(hunks: DataFrame, files: DataFrame, as_lines: bool = False) -> DataFrame:
    """Each hunk with its target's content and checksum; both null when there is no such file.

    With `as_lines`, a file is cut into `_lines` once, before its hunks meet it.
    """
    counts = key_counts(hunks, KEY)
    target = only_named(files.select(*KEY, "content"), counts, KEY)
    target = target.withColumn("base_sha1", sha1_content(F.col("content")))
    if as_lines:
        target = target.withColumn("_lines", once(split_lines(F.col("content")))).drop("content")
    joined = skew_join(hunks, target, KEY, "left", HUNK_ID, redistribute=True, counts=counts)
    return joined.withColumn("file_exists", F.col("base_sha1").isNotNull())


def with_needle(targets: DataFrame) -> DataFrame:
    """Adds the file's `_lines`, and `_needle`: the lines the hunk expects to find."""
    needle = original_lines(F.col("context_before"), F.col("hunk_lines"), F.col("context_after"))
    lines = F.col("_lines") if "_lines" in targets.columns else split_lines(F.col("content"))
    return targets.withColumns({
        "_lines": once(F.coalesce(lines, F.array().cast("array<string>"))), "_needle": once(needle),
    })


def _at(array: Column, index: Column) -> Column:
    return F.get(array, index)


def candidate_starts(targets: DataFrame) -> DataFrame:
    """Adds `_starts`, the 0-based lines where a hunk may begin.

    The first non-blank line after the leading context is sought as a substring.
    If any hit leaves room for the hunk, only hits count; else every start does.
    """
    lines, needle = F.col("_lines"), F.col("_needle")
    before, m, n = F.size("context_before"), F.size("_needle"), F.size("_lines")
    telling = F.when(
        m > before,
        _at(F.filter(F.sequence(before, F.greatest(m - 1, before)), lambda i: ~is_blank(_at(needle, i))), F.lit(0)),
    )
    fits = (n > 0) & (m > 0) & (m <= n)

    def hits(probe: Column) -> Column:
        at = F.transform(lines, lambda line, i: F.when(line.contains(probe["text"]), i - probe["offset"]))
        return F.filter(at, lambda s: (s >= 0) & (s <= n - m))

    found = let(
        F.struct(telling.alias("offset"), strip(_at(needle, telling)).alias("text")),
        lambda probe: F.when(probe["offset"].isNotNull(), hits(probe)).otherwise(F.array().cast("array<int>")),
    )
    every = F.sequence(F.lit(0), F.greatest(n - m, F.lit(0)))
    starts = F.when(fits, let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(every)))
    return targets.withColumn("_starts", once(F.coalesce(starts, F.array().cast("array<int>"))))


def exact_starts() -> Column:
    """Candidates where every line agrees up to whitespace."""
    lines = F.col("_lines")

    def agree(wanted: Column) -> Column:
        return F.filter(
            F.col("_starts"),
            lambda s: (normalize_line(_at(lines, s)) == _at(wanted, F.lit(0)))
            & (F.transform(F.slice(lines, s + 1, F.size(wanted)), normalize_line) == wanted),
        )

    return let(F.transform(F.col("_needle"), normalize_line), agree)


def _normal(lines: list[str]) -> list[str]:
    return [" ".join(line.split()) for line in lines]


def best_window(lines: list[str], needle: list[str], starts: list[int], required: float) -> dict:
    """The start with the highest ratio of common lines; none if two share it."""
    lines, needle = _normal(lines), _normal(needle)
    size, wanted = len(needle), Counter(needle)
    scores: dict[int, float] = {}
    for start in starts:
        window = lines[start : start + size]
        # Lines in common, in any order, bound the ratio from above.
        if sum((wanted & Counter(window)).values()) / size < required:
            continue
        ratio = difflib.SequenceMatcher(None, window, needle, autojunk=False).ratio()
        if ratio >= required:
            scores[start] = ratio
    best = max(scores.values(), default=None)
    top = [s for s, r in scores.items() if best - r < RATIO_EPSILON] if scores else []
    return {"start": top[0] if len(top) == 1 else None, "ratio": best, "n_best": len(top)}


def _scorer(max_distance: float):
    required = 1.0 - max_distance - RATIO_EPSILON

    @F.pandas_udf("struct<start:int,ratio:double,n_best:int>")
    def score(lines: pd.Series, needles: pd.Series, starts: pd.Series) -> pd.DataFrame:
        none = {"start": None, "ratio": None, "n_best": 0}
        rows = [
            none if needle is None else best_window(list(ls), list(needle), [int(s) for s in st], required)
            for ls, needle, st in zip(lines, needles, starts)
        ]
        frame = pd.DataFrame(rows, columns=["start", "ratio", "n_best"])
        return frame.astype({"start": "Int32", "ratio": "float64", "n_best": "int32"})

    return score


def best_match(candidates: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Adds `first_target_line`, `match_ratio` and `n_best` from the candidate starts.

    A window has as many lines as the hunk expects, so below 1/max_distance
    lines the tolerance leaves only agreement of every line: an array
    comparison. Longer hunks that agree nowhere are scored in Python.
    """
    exact = candidates.withColumn("_exact", once(exact_starts()))
    long_enough = F.size("_needle") * (max_distance + RATIO_EPSILON) >= 1
    fuzzy = long_enough & (F.size("_exact") == 0) & (F.size("_starts") > 0)
    scored = exact.withColumn(
        "_fuzzy",
        _scorer(max_distance)(
            F.when(fuzzy, F.col("_lines")), F.when(fuzzy, F.col("_needle")), F.when(fuzzy, F.col("_starts"))
        ),
    )
    opens_empty_file = (
        (F.size("_lines") == 0) & (F.size("context_before") == 0) & (F.size("context_after") == 0)
        & pure_addition(F.col("hunk_lines"))
    )
    n_exact = F.size("_exact")
    start = (
        F.when(opens_empty_file, F.lit(0))
        .when(n_exact == 1, _at(F.col("_exact"), F.lit(0)))
        .when(n_exact == 0, F.col("_fuzzy.start"))
    )
    return scored.withColumns({
        "first_target_line": once(start.cast("long")),
        "match_ratio": F.when(opens_empty_file | (n_exact > 0), F.lit(1.0)).otherwise(F.col("_fuzzy.ratio")),
        "n_best": F.when(opens_empty_file, F.lit(1)).when(n_exact > 0, n_exact).otherwise(F.col("_fuzzy.n_best")).cast("long"),
    }).drop("_exact", "_fuzzy")


def _starts_of_probes(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(_id, _starts): where the telling line's text occurs and the hunk has room, sorted; only hunks with such a place."""
    found = piece_places(asked.select("_id", *KEY, "_probe"), files)
    room = asked.select("_id", "_tell", (F.col("n_lines") - F.col("_m")).alias("_room"))
    start = F.col("line") - F.col("_tell")
    starts = found.join(room, "_id").filter((start >= 0) & (start <= F.col("_room")))
    return starts.groupBy("_id").agg(F.array_sort(F.collect_set(start.cast("int"))).alias("_starts"))


def _undecided(asked: DataFrame, exact: DataFrame, files: DataFrame) -> DataFrame:
    """(_id, start) of exact places, for hunks where white space inside the telling line matters.

    If the line's text occurs anywhere in the file, only places count where it does.
    """
    spots = asked.select("_id", *KEY, "_tell", "_probe").join(exact.select("_id", "start"), "_id")
    lines = numbered_lines(files, asked)
    seen = spots.withColumn("line", F.col("start") + F.col("_tell")).join(lines, [*KEY, "line"])
    checked = kept(seen.select("_id", "start", (strip(F.col("text")) == F.col("_probe")).alias("same")))
    same = checked.filter("same").select("_id", "start")
    open_ = kept(asked.join(same, "_id", "left_anti"))
    if open_.isEmpty():
        return same
    elsewhere = kept(_starts_of_probes(open_, files).select("_id"))
    nowhere = open_.select("_id").join(elsewhere, "_id", "left_anti")
    return same.unionByName(checked.select("_id", "start").join(nowhere, "_id", "left_semi"))


def _scored(asked: DataFrame, files: DataFrame, max_distance: float) -> DataFrame:
    """(_id, _fuzzy) of long questions that agree nowhere in full; a file's lines go only to such."""
    probed = asked.filter(F.col("_tell").isNotNull()).withColumn("_probe", strip(F.get("_needle", F.col("_tell"))))
    target = file_lines(only_named(files.select(*KEY, "content"), asked, KEY)).select(*KEY, "_lines")
    rows = skew_join(asked, target, KEY, "inner", ["_id"], redistribute=True)
    every = F.sequence(F.lit(0), F.size("_lines") - F.col("_m"))
    if probed.isEmpty():
        rows = rows.withColumn("_starts", every)
    else:
        rows = rows.join(_starts_of_probes(probed, files), "_id", "left").withColumn("_starts", F.coalesce("_starts", every))
    return rows.select("_id", _scorer(max_distance)(F.col("_lines"), F.col("_needle"), F.col("_starts")).alias("_fuzzy"))


def locate_hunks(hunks: DataFrame, files: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Hunks with `status` matched or unmatched and their 0-based `first_target_line`.

    Exact places come from an index of the files' lines, whatever the number of
    hunks on a file; hunks that ask the same of a file are one question. The text of
    lines is read again only for hunks that agree with a place but for white space
    inside a line, and for those of 1/max_distance lines or more that agree with
    none: these are scored. Neither hunks nor contents are stored: both inputs are
    read more than once, hunks are shuffled once, with those of their columns that the
    caller reads, and contents not at all but for the scoring.
    """
    needle = original_lines(F.col("context_before"), F.col("hunk_lines"), F.col("context_after"))
    long_from = ceil(1 / (max_distance + RATIO_EPSILON))
    narrow = described(hunks, needle, long_from)
    index = file_index(files, narrow)
    asked = narrow.drop("_needle", "_rows")
    exact = places(asked, index)
    found = exact.groupBy("_id").agg(F.count("*").alias("_n"), F.count_if(~F.col("sure")).alias("_unsure"), F.min("start").alias("_at"))
    if not exact.filter("not sure").isEmpty():
        unsure = with_probe(kept(asked.join(found.filter("_unsure > 0"), "_id", "left_semi")), hunks, needle)
        doubtful = kept(with_file(unsure, index))
        settled = _undecided(doubtful, exact, files).groupBy("_id").agg(F.count("*").alias("_n"), F.min("start").alias("_at"))
        found = found.filter("_unsure = 0").select("_id", "_n", "_at").unionByName(settled)
    found = found.select("_id", "_n", "_at")

    nowhere = narrow.filter(F.col("_m") >= long_from).join(found, "_id", "left_anti")
    none = F.lit(None).cast("struct<start:int,ratio:double,n_best:int>")
    scores = None
    if not nowhere.isEmpty():
        open_ = kept(with_file(nowhere, index).filter(F.col("_m") <= F.col("n_lines")))
        scores = kept(_scored(open_, files, max_distance))
    answers = with_file(asked.select("_id", *KEY), index).drop(*KEY)
    answers = answers.join(found, "_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    answers = answers.withColumn("_fuzzy", none) if scores is None else answers.join(scores, "_id", "left")
    # Decided before the join, so that texts are moved only if the caller wants them.
    adds = (F.size("context_before") == 0) & (F.size("context_after") == 0) & pure_addition(F.col("hunk_lines"))
    rows = identified(hunks, needle).withColumn("_adds", once(adds)).drop("_needle")
    rows = skew_join(rows, answers, ["_id"], "left", HUNK_ID, counts=narrow.select("_id", "_rows"))

    opens_empty_file = (F.coalesce("n_lines", F.lit(0)) == 0) & F.col("_adds")
    start = (
        F.when(opens_empty_file, F.lit(0))
        .when(F.col("_n") == 1, F.col("_at"))
        .when(F.col("_n") == 0, F.col("_fuzzy.start"))
        .cast("long")
    )
    best = F.when(opens_empty_file, F.lit(1)).when(F.col("_n") > 0, F.col("_n")).otherwise(F.coalesce("_fuzzy.n_best", F.lit(0)))
    return rows.select(
        *hunks.columns, "base_sha1", "file_exists", start.alias("first_target_line"),
        F.when(opens_empty_file | (F.col("_n") > 0), F.lit(1.0)).otherwise(F.col("_fuzzy.ratio")).alias("match_ratio"),
        best.cast("long").alias("n_best"), F.when(start.isNotNull(), "matched").otherwise("unmatched").alias("status"),
    )
