"""Locating and applying against a brute-force model."""

from __future__ import annotations

import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators.applying import apply_hunk_lines, apply_proposed, apply_reports, apply_summary, overlap_check, verify_applied
from folioflow.operators.extraction import extract_changes
from folioflow.operators.locating import best_window, locate_hunks
from folioflow.operators.review import annotate_hunk
from folioflow.plans import edit_files
from folioflow.schemas import HUNKS

FILE = "project_id string, rel_path string, content string"


def normal(line: str) -> str:
    return " ".join(line.split())


def original(hunk) -> list[str]:
    before, body, after = hunk
    return before + [x[1:] if x[:1] in ("-", " ") else x for x in body if not x.startswith("+")] + after


def brute_locate(lines: list[str], hunk, distance=0.05) -> int | None:
    """Every start the substring search allows, scored with difflib."""
    before, body, after = hunk
    if not lines:
        return 0 if not before and not after and all(x.startswith("+") for x in body) else None
    needle = original(hunk)
    if not needle or len(needle) > len(lines):
        return None
    room = len(lines) - len(needle)
    offset = next((i for i in range(len(before), len(needle)) if needle[i].strip()), None)
    starts = []
    if offset is not None:
        starts = [i - offset for i, line in enumerate(lines) if needle[offset].strip() in line and 0 <= i - offset <= room]
    starts = starts or range(room + 1)
    scores = {}
    for s in starts:
        ratio = difflib.SequenceMatcher(None, [normal(x) for x in lines[s : s + len(needle)]], [normal(x) for x in needle], autojunk=False).ratio()
        if ratio >= 1 - distance - 1e-9:
            scores[s] = ratio
    if not scores:
        return None
    best = [s for s, r in scores.items() if max(scores.values()) - r < 1e-9]
    return best[0] if len(best) == 1 else None


def brute_apply(lines: list[str], hunks: list[tuple[int, tuple]]) -> str:
    """Later hunks first, so that earlier places stay where they are."""
    out = list(lines)
    for start, (before, body, after) in sorted(hunks, key=lambda h: h[0], reverse=True):
        at, new = start + len(before), []
        end = at + sum(not x.startswith("+") for x in body)
        kept = iter(range(at, end))
        for x in body:
            if x.startswith("+"):
                new.append(x[1:])
            else:
                i = next(kept)
                if not x.startswith("-"):
                    new.append(lines[i])
        out[at:end] = new
    return "\n".join(out) + "\n" if out else ""


def run(spark, files: dict[str, str], hunks: list[tuple[str, tuple]]):
    f = spark.createDataFrame([("p", path, text) for path, text in files.items()], FILE)
    rows = [(1, i, "p", path, list(h[1]), list(h[0]), list(h[2])) for i, (path, h) in enumerate(hunks)]
    located = locate_hunks(spark.createDataFrame(rows, HUNKS), f).cache()
    reports = apply_reports(located, f)
    return f, located, reports


def random_case(rng: random.Random):
    words = ["a", "b", "c", "x = 1", "  x = 1", "x  =  1", "", "  ", "-- c", "+p", "def f():"]
    lines = [rng.choice(words) for _ in range(rng.randrange(1, 14))]
    if rng.random() < 0.3:
        lines = [f"{line} {i}" for i, line in enumerate(lines)]
    start = rng.randrange(len(lines))
    length = rng.randrange(1, 6)
    piece = lines[start : start + length]
    cut = rng.randrange(len(piece) + 1)
    before, rest = piece[:cut], piece[cut:]
    cut = rng.randrange(len(rest) + 1)
    middle, after = rest[:cut], rest[cut:]
    body = []
    for line in middle:
        kind = rng.random()
        body.append(("-" if kind < 0.5 else " ") + (line if rng.random() < 0.8 else line.replace(" ", "  ")))
        if rng.random() < 0.4:
            body.append("+new")
    if rng.random() < 0.2:
        body.insert(0, "+first")
    if rng.random() < 0.1:
        body.append("-gone")
    return lines, (before, body, after)


def test_locate_spaces_and_pieces_random(spark):
    """Places that differ in white space inside lines, next to lines that only hold the telling text."""
    rng = random.Random(5)
    words = ["x = 1", "x  =  1", " x = 1 ", "y", "yy", "éß y", "x = 1;", "if x = 1:", "\tx = 1", "a\u00a0b", "a b", "a  b c", ""]
    files, hunks = {}, []
    for i in range(60):
        lines = [rng.choice(words) for _ in range(rng.randrange(1, 30))]
        files[f"f{i}.py"] = "\n".join(lines)
        for _ in range(8):
            at, m = rng.randrange(len(lines)), rng.randrange(1, 7)
            piece = [rng.choice(words) if rng.random() < 0.1 else x.replace(" ", rng.choice([" ", "  "])) for x in lines[at : at + m]]
            cut = rng.randrange(len(piece) + 1)
            hunks.append((f"f{i}.py", (piece[:cut], ["-" + x for x in piece[cut:]], [])))
    # Long hunks with one line changed are scored where the telling text occurs.
    for i in range(60, 90):
        lines = [f"{rng.choice(words)} {k if rng.random() < 0.9 else ''}" for k in range(50)]
        files[f"f{i}.py"] = "\n".join(lines)
        at = rng.randrange(20)
        piece = lines[at : at + rng.randrange(19, 28)]
        piece[rng.randrange(len(piece))] += " changed"
        hunks.append((f"f{i}.py", (piece[:2], ["-" + x for x in piece[2:]], [])))
    hunks += [("f0.py", ([], ["+x"], [])), ("nowhere.py", ([], ["+x"], [])), ("nowhere.py", ([], ["-x"], []))]
    located = run(spark, files, hunks)[1]
    found = {r.hunk_pos: r.first_target_line for r in located.collect()}
    expected = {i: brute_locate(files.get(path, "").splitlines(), h) for i, (path, h) in enumerate(hunks)}
    assert found == expected
    assert sum(s is not None for s in expected.values()) > 100
    assert sum(expected[i] is not None for i in range(480, 510)) > 5


def test_index_asks_for_few_lines(spark):
    """A hunk meets the index by the hashes of its lines: no row per hunk and line of the file."""
    from folioflow.operators import lineindex

    lines = [f"line {i} of many" for i in range(3000)]
    f = spark.createDataFrame([("p", "big.py", "\n".join(lines))], FILE)
    rows = [(1, i, "p", "big.py", ["-" + x for x in lines[i : i + 5]], lines[i - 3 : i], []) for i in range(3, 2900)]
    hunks = lineindex.described(spark.createDataFrame(rows, HUNKS), F.concat("context_before", F.transform("hunk_lines", lambda x: F.substring(x, F.lit(2), F.length(x)))))
    index = lineindex.file_index(f, hunks)
    found = lineindex.places(hunks, index)
    assert found.count() == len(rows) and found.filter("sure").count() == len(rows)
    assert [r._levels for r in index.select("_levels").collect()] == [[3]]


def test_equal_hunks_are_one_question(spark):
    """Hunks that ask the same of a file of equal lines meet its places once, not once each."""
    from folioflow.functions.hunks import original_lines
    from folioflow.operators import lineindex

    f = spark.createDataFrame([("p", "big.py", "same\n" * 300)], FILE)
    rows = [(r, 0, "p", "big.py", ["-same", "+other"], ["same"], []) for r in range(400)]
    hunks = spark.createDataFrame(rows, HUNKS)
    asked = lineindex.described(hunks, original_lines(F.col("context_before"), F.col("hunk_lines"), F.col("context_after")))
    assert [r._rows for r in asked.collect()] == [400]
    assert lineindex.places(asked, lineindex.file_index(f, asked)).count() == 299
    located = locate_hunks(hunks, f)
    assert [(r.status, r.n_best) for r in located.collect()] == [("unmatched", 299)] * 400


def test_index_holds_no_text(spark):
    """Questions and index are made of hashes: neither the lines of hunks nor those of files are stored or shuffled for them."""
    import os
    from urllib.parse import urlparse

    from folioflow.functions.hunks import original_lines
    from folioflow.operators import lineindex

    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)) for _ in range(20)]
    f = spark.createDataFrame([("p", "a.py", "\n".join(lines))], FILE)
    rows = [(1, i, "p", "a.py", ["-" + lines[i], "+new"], lines[i - 1 : i], []) for i in range(1, 20)]
    hunks = spark.createDataFrame(rows, HUNKS)
    asked = lineindex.described(hunks, original_lines(F.col("context_before"), F.col("hunk_lines"), F.col("context_after")))
    index = lineindex.file_index(f, asked)
    stored = sum(os.path.getsize(urlparse(path).path) for df in (asked, index) for path in df.inputFiles())
    assert stored < sum(map(len, lines)) / 10
    assert {r.hunk_pos: r.first_target_line for r in locate_hunks(hunks, f).collect()} == {i: i - 1 for i in range(1, 20)}


def test_reports_move_no_text(spark):
    """Hunks that are measured are located and reported on without their texts: no shuffle and no table holds these."""
    from folioflow.operators import applying as A

    files = {f"f{i}.py": "\n".join(f"{i} line {j}" for j in range(9)) for i in range(6)}
    at = lambda i, j: ([f"{i} line {j - 1}"], [f"-{i} line {j}", "+new", "+more"], [f"{i} line {j + 1}"])
    rows = [(1, 10 * i + j, "p", f"f{i}.py", at(i, j)) for i in range(6) for j in ((1, 4, 7) if i % 2 else (1, 3, 5))]
    rows += [(1, 60, "p", "f1.py", (["gone"], ["-gone"], [])), (1, 61, "p", "none.py", ([], ["-x"], [])), (1, 62, "p", "new.py", ([], ["+x"], []))]
    f = spark.createDataFrame([("p", path, text) for path, text in files.items()], FILE)
    hunks = spark.createDataFrame([(r, n, p, path, h[1], h[0], h[2]) for r, n, p, path, h in rows], HUNKS)
    whole = locate_hunks(hunks, f).cache()
    assert not any("Exchange" in part and "hunk_lines" in part for part in plan_nodes(spark, locate_hunks(hunks, f).drop(*A.TEXTS)))
    narrow = locate_hunks(A.measured(hunks), f).drop(*A.TEXTS).cache()
    same = lambda make: sorted(map(str, make(whole).collect())) == sorted(map(str, make(narrow).collect()))
    assert {r.status for r in apply_reports(narrow, f).collect()} == {"ok", "skipped_overlap", "skipped_unmatched", "failed_read"}
    assert same(lambda located: apply_reports(located, f)) and same(A.lines_applied) and same(A.hunk_offsets)
    assert same(overlap_check) and same(lambda located: overlap_check(located, "shifted"))


def plan_nodes(spark, df) -> list[str]:
    """The nodes of a plan as it is before it runs, each with its columns; no join is a broadcast for its size."""
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "formatted").split("\n\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_places_keep_to_their_file(spark):
    """A window's key names its file: equal lines of other files are no places, swapped and missing names included."""
    names = [("a", "b"), ("b", "a"), ("ab", ""), ("a", None), (None, "a"), (None, None)]
    f = spark.createDataFrame([(p, path, "\n".join(["same"] + ["x"] * i)) for i, (p, path) in enumerate(names)], FILE)
    rows = [(i, 0, p, path, ["-same"], [], []) for i, (p, path) in enumerate(names)]
    located = locate_hunks(spark.createDataFrame(rows, HUNKS), f).collect()
    assert {r.response_id: (r.status, r.n_best, r.file_exists) for r in located} == {
        i: ("matched", 1, True) if None not in name else ("unmatched", 0, False) for i, name in enumerate(names)
    }


def test_many_pieces_sought_in_one_file(spark, monkeypatch):
    """Few strings are sought in the lines one by one, many are listed: the same lines are found."""
    from folioflow.operators import lineindex

    lines = [f"value {i % 7} of {i}" for i in range(60)]
    f = spark.createDataFrame([("p", "a.py", "\n".join(lines))], FILE)
    probes = [f"of {i}" for i in range(0, 60, 3)] + ["v", "nowhere"]
    pieces = spark.createDataFrame([(i, "p", "a.py", x) for i, x in enumerate(probes)], "_id int, project_id string, rel_path string, _probe string")
    expected = {(i, n) for i, x in enumerate(probes) for n, line in enumerate(lines) if x in line}
    for few in (0, 1000):
        monkeypatch.setattr(lineindex, "FEW_GRAMS", few)
        assert {(r._id, r.line) for r in lineindex.piece_places(pieces, f).collect()} == expected


@pytest.mark.parametrize("chunk_lines", [1, 4, 1024])
def test_pieces_random(spark, monkeypatch, chunk_lines):
    """Many hunks on each file, insertions at one place and at the ends among them, over chunks of any size."""
    from folioflow.operators import applying

    monkeypatch.setattr(applying, "CHUNK_LINES", chunk_lines)
    rng = random.Random(chunk_lines)
    files, hunks, expected = {}, [], {}
    for f in range(40):
        lines = [f"{rng.choice('ab')} line {i}" for i in range(rng.randrange(0, 14))]
        at, own = 0, []
        while at <= len(lines):
            m = min(rng.randrange(0, 4), len(lines) - at)
            body = [x for line in lines[at : at + m] for x in ([rng.choice("- ") + line] + ["+new", "+"][: rng.randrange(3)])]
            if rng.random() < 0.4:
                body.insert(0, f"+first {at}")
            if rng.random() < 0.7 and body:
                own.append((at, ([], body, [])))
            at += m + rng.randrange(1, 4)
        files[f"f{f}.py"] = "\n".join(lines)
        hunks += [(f"f{f}.py", h, at) for at, h in own]
        if own:
            expected[f"f{f}.py"] = brute_apply(lines, own)
    rows = [(1, i, "p", path, h[1], h[0], h[2], at, "matched") for i, (path, h, at) in enumerate(hunks)]
    located = spark.createDataFrame(rows, HUNKS.simpleString()[7:-1] + ", first_target_line:long, status:string")
    reports = located.select("project_id", "rel_path", F.lit("ok").alias("status")).distinct()
    table = spark.createDataFrame([("p", path, text) for path, text in files.items()], FILE)
    got = {r.rel_path: r.new_content for r in apply_hunk_lines(located, reports, table).collect()}
    assert got == expected


def test_many_additions_to_a_new_file(spark):
    n = 100_000
    rows = spark.range(n).selectExpr(
        "1L AS response_id", "id AS hunk_pos", "'p' AS project_id", "'new.py' AS rel_path", "array(concat('+line ', id)) AS hunk_lines",
        "cast(array() AS array<string>) AS context_before", "cast(array() AS array<string>) AS context_after",
        "0L AS first_target_line", "'matched' AS status",
    )
    reports = spark.createDataFrame([("p", "new.py", "ok")], "project_id string, rel_path string, status string")
    row = apply_hunk_lines(rows, reports, spark.createDataFrame([], FILE)).first()
    assert row.new_content == "".join(f"line {i}\n" for i in range(n)) and row.old_content is None


def test_locate_and_apply_random(spark):
    rng = random.Random(11)
    cases = [random_case(rng) for _ in range(400)]
    files = {f"f{i}.py": "\n".join(lines) for i, (lines, _) in enumerate(cases)}
    f, located, reports = run(spark, files, [(f"f{i}.py", h) for i, (_, h) in enumerate(cases)])
    starts = {r.rel_path: r.first_target_line for r in located.collect()}
    split = {path: text.splitlines() for path, text in files.items()}
    expected = {f"f{i}.py": brute_locate(split[f"f{i}.py"], h) for i, (_, h) in enumerate(cases)}
    assert starts == expected
    assert 50 < sum(s is not None for s in starts.values()) < 400
    new = {r.rel_path: r.new_content for r in apply_hunk_lines(located, reports, f).collect()}
    assert set(new) == {p for p, s in expected.items() if s is not None}
    for i, (_, h) in enumerate(cases):
        path = f"f{i}.py"
        if path in new:
            assert new[path] == brute_apply(split[path], [(expected[path], h)]), path


def test_many_hunks_in_one_file(spark):
    lines = [f"line {i}" for i in range(200)]
    hunks = [([lines[i - 1]], [f"-{lines[i]}", f"+{lines[i]}!", "+extra", f" {lines[i + 1]}"], []) for i in range(5, 190, 7)]
    f, located, reports = run(spark, {"a.py": "\n".join(lines)}, [("a.py", h) for h in hunks])
    assert [(r.status, r.lines_applied) for r in reports.collect()] == [("ok", 3 * len(hunks))]
    new = apply_hunk_lines(located, reports, f).first().new_content
    assert new == brute_apply(lines, [(i - 1, h) for i, h in zip(range(5, 190, 7), hunks)])


@pytest.mark.parametrize("size, changed, found", [(19, 1, False), (20, 1, True), (21, 1, True), (40, 2, True), (40, 3, False)])
def test_long_hunks(spark, size, changed, found):
    lines = [f"line {i}" for i in range(60)]
    piece = lines[10 : 10 + size]
    for i in range(changed):
        piece[5 * i + 5] = "other"
    hunk = (piece, ["+new"], [])
    _, located, _ = run(spark, {"a.py": "\n".join(lines)}, [("a.py", hunk)])
    assert located.first().first_target_line == (10 if found else None)
    assert brute_locate(lines, hunk) == (10 if found else None)


def test_long_hunks_random(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(60):
        lines = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(25, 70))]
        start, size = rng.randrange(5), rng.randrange(18, 25)
        piece = lines[start : start + size]
        for _ in range(rng.randrange(3)):
            piece[rng.randrange(len(piece))] = "changed"
        if rng.random() < 0.3:
            piece.insert(rng.randrange(len(piece)), "inserted")
        cases.append((lines, (piece[:3], [f"-{x}" for x in piece[3:6]], piece[6:])))
    files = {f"f{i}": "\n".join(lines) for i, (lines, _) in enumerate(cases)}
    _, located, _ = run(spark, files, [(f"f{i}", h) for i, (_, h) in enumerate(cases)])
    got = {r.rel_path: r.first_target_line for r in located.collect()}
    assert got == {f"f{i}": brute_locate(lines, h) for i, (lines, h) in enumerate(cases)}


def test_best_window_tie_is_no_match():
    lines = ["a"] * 3 + ["b"] + ["a"] * 3 + ["b"]
    assert best_window(lines, ["a", "b"], list(range(7)), 0.95)["start"] is None


@pytest.mark.parametrize("files, hunk, status, start", [
    ({}, ([], ["+a", "+b"], []), "ok", 0),
    ({}, ([], ["-a", "+b"], []), "failed_read", None),
    ({}, (["c"], ["+b"], []), "skipped_unmatched", None),
    ({"n.py": ""}, ([], ["+a"], []), "ok", 0),
    ({"n.py": "x"}, ([], ["+a"], []), "skipped_unmatched", None),
    ({"n.py": "x"}, (["x"], [], []), "ok", 0),
    ({"n.py": "-- sql comment\nx"}, ([], ["--- sql comment"], ["x"]), "ok", 0),
    ({"n.py": "a\nb\na\nb"}, (["a"], ["-b"], []), "skipped_unmatched", None),
])
def test_edge_hunks(spark, files, hunk, status, start):
    _, located, reports = run(spark, files, [("n.py", hunk)])
    assert reports.first().status == status
    if status == "ok":
        assert located.first().first_target_line == start


def test_new_file_is_written(spark):
    f, located, reports = run(spark, {}, [("n.py", ([], ["+a", "+b"], []))])
    assert apply_hunk_lines(located, reports, f).first().new_content == "a\nb\n"


def test_overlap(spark):
    lines = [f"l{i}" for i in range(12)]
    grows = ([lines[0]], [f"-{lines[1]}", "+x", "+y", "+z"], [lines[2]])
    inside = ([lines[1]], [f"-{lines[2]}"], [])
    beside = ([lines[3]], [f"-{lines[4]}"], [])
    files = {"a": "\n".join(lines), "b": "\n".join(lines)}
    _, located, reports = run(spark, files, [("a", grows), ("a", inside), ("b", grows), ("b", beside)])
    assert {r.rel_path: r.status for r in reports.collect()} == {"a": "skipped_overlap", "b": "ok"}
    # The shifted comparison does not see the overlap behind a hunk that adds lines.
    assert overlap_check(located, "shifted").isEmpty()


def test_external_change(spark):
    f, located, _ = run(spark, {"a": "x\ny"}, [("a", (["x"], ["-y", "+z"], []))])
    changed = f.withColumn("content", F.lit("x\ny\n"))
    assert apply_reports(located, changed).first().status == "skipped_external_change"
    assert apply_reports(located, f.limit(0)).first().status == "failed_read"


def test_inverse_restores_the_file(spark):
    text = "one\ntwo\nthree\nfour\n"
    f, located, reports = run(spark, {"a": text}, [("a", (["one"], ["-two", "+2", "+2b"], ["three"]))])
    once = apply_hunk_lines(located, reports, f).first().new_content
    assert once == "one\n2\n2b\nthree\nfour\n"
    f, located, reports = run(spark, {"a": once}, [("a", (["one"], ["-2", "-2b", "+two"], ["three"]))])
    assert apply_hunk_lines(located, reports, f).first().new_content == text


def test_preview_of_new_file_and_kept_lines(spark):
    f, located, _ = run(spark, {"a": "x\ny\nz"}, [("a", ([], [" x", "-y", "+Y"], ["z"])), ("n", ([], ["+new <line>"], []))])
    rows = [(r.rel_path, r.label, r.text) for r in annotate_hunk(located, f).orderBy("rel_path", "line_no").collect()]
    assert rows == [
        ("a", "hunk-context-hunk", "x"), ("a", "hunk-deleted", "y"), ("a", "hunk-added", "Y"), ("a", "hunk-context-after", "z"),
        ("n", "diff-header", "--- New File ---"), ("n", "hunk-added", "new &lt;line&gt;"),
    ]


def test_verify_applied(spark):
    before, after = "a\nb\nc\n", "a\nB\nc\nd\n"
    diff = "\n".join(difflib.unified_diff(before.splitlines(), after.splitlines(), "a/x", "b/x", lineterm=""))
    rows = [(1, "p", "x", diff, after), (2, "p", "x", diff.replace("+d", "+e"), after), (3, "p", "y", diff, after), (4, "p", "x", "", after), (5, "p", "x", diff, None)]
    s = spark.createDataFrame(rows, "response_id long, project_id string, rel_path string, diff_text string, proposed_content string")
    f = spark.createDataFrame([("p", "x", before)], FILE)
    out = verify_applied(apply_proposed(s, f)).orderBy("response_id").collect()
    assert [r.status for r in out] == ["applied_ok", "applied_with_discrepancies", "applied_ok", "applied_ok", "failed"]


RESPONSES = {
    "object": ('{"file": "a.py", "hunk": ["+x"]}', [("a.py", ["+x"])]),
    "hunk_lines key": ('{"file": "a.py", "hunk_lines": ["+x"]}', [("a.py", ["+x"])]),
    "text around": ('see {"file": "a.py", "hunk": ["+x"]} done', []),
    "fenced upper case": ('```json x\n```JSON\n[{"file": "a.py", "hunk": ["+x"]}]\n```', []),
    "fenced": ('text\n```json\n[{"file": "a.py", "hunk": ["+x"]}, {"file": "b.py", "hunk": []}, {"file": "c.py", "hunk": [], "hunk_lines": []}]\n```\n', [("a.py", ["+x"]), ("c.py", [])]),
    "backslash path": ('[{"file": "d\\\\a.py", "hunk": ["-x"]}]', [("d/a.py", ["-x"])]),
    "unsafe paths": ('[{"file": "../a.py", "hunk": ["-x"]}, {"file": "/a.py", "hunk": ["-x"]}]', []),
    "null element": ('[{"file": "a.py", "hunk": ["-x", null]}]', []),
    "not json": ("[not json]", []),
    "blank": ("  \n ", []),
}


@pytest.mark.parametrize("name", sorted(RESPONSES))
def test_json_responses(spark, name):
    text, expected = RESPONSES[name]
    rows = spark.createDataFrame([(1, "p", text)], "response_id long, project_id string, text string")
    got = [(r.rel_path, r.hunk_lines) for r in extract_changes(rows).hunks.orderBy("hunk_pos").collect()]
    assert got == expected


def test_json_diff_and_content(spark):
    text = '[{"file": "a.py", "diff": "-x\\n+y\\n", "proposed_content": "y\\n"}]'
    rows = spark.createDataFrame([(1, "p", text)], "response_id long, project_id string, text string")
    got = extract_changes(rows).suggestions.first()
    assert (got.rel_path, got.diff_text, got.proposed_content, got.lines_added, got.lines_deleted) == ("a.py", "-x\n+y", "y\n", 1, 1)


def test_responses_need_one_worker(spark):
    """JSON and XML are read in one Python worker per task, and XML inside of JSON is neither a change nor an error."""
    xml = '<diff file="a.py">+x</diff>'
    texts = [
        '[{"file":"a.py","hunk":["+<diff file=never closed"]}]', '{"file":"a.py","hunk":["+<diff file="],"n":NaN}',
        xml, '<diff file="a.py">never closed', "{" + xml + "}", None, *[f"{xml}{i}" for i in range(300)],
    ]
    rows = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "response_id long, project_id string, text string").coalesce(1)
    found = extract_changes(rows)
    kinds = {r.response_id: r.kind for r in found.records.collect()}
    assert kinds == {0: "hunk", 1: "hunk", 2: "diff", 3: "error", 4: "diff", **{i: "diff" for i in range(6, 306)}}
    plan = found.errors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_xml_and_markdown_pairing(spark):
    xml = (
        '<wrap><diff file="a.py"> -x </diff><diff file="a.py">-y</diff><proposed_content file="a.py">old</proposed_content></wrap>'
        '<proposed_content file="./a.py">new</proposed_content><proposed_content file="n.py"><![CDATA[<b>]]></proposed_content>'
        '<diff file="../x">-q</diff><diff>-none</diff>'
    )
    md = "```diff file='m.py'\n-a\n+b\n```\n```js-x file=\"m.py\" type=\"proposed\"\nfirst\n```\n```python file=\"m.py\" type=\"proposed\"\nb\n```\n```diff file=\"\"\n-z\n```\n"
    md = md.replace("```diff file='m.py'", "```diff file=\"k.py\"\n-k\n```\n```diff file='m.py'")
    rows = spark.createDataFrame([(1, "p", xml), (2, "p", md), (3, "p", '<diff file="a">')], "response_id long, project_id string, text string")
    found = extract_changes(rows)
    got = {(r.response_id, r.rel_path): (r.diff_text, r.proposed_content) for r in found.suggestions.collect()}
    assert got == {
        (1, "a.py"): ("-y", "new"), (1, "n.py"): ("", "<b>"), (2, "k.py"): ("-k", None), (2, "m.py"): ("-a\n+b", "b"),
    }
    assert [(r.file, r.path_problem) for r in found.rejects.collect()] == [("../x", "outside project root")]
    assert [r.response_id for r in found.errors.collect()] == [3]


def test_edit_files(spark):
    files = spark.createDataFrame([("p", "a.py", "x\ny\n"), ("p", "b.py", "q\n")], FILE)
    responses = spark.createDataFrame([
        (1, "p", '[{"file": "a.py", "hunk": ["-y", "+z"], "context_before": ["x"]}]'),
        (2, "p", '<diff file="b.py">-q\n+r</diff><proposed_content file="b.py">r</proposed_content>'),
    ], "response_id long, project_id string, text string")
    result = edit_files(responses, files)
    assert [(r.rel_path, r.new_content) for r in result.new_files.collect()] == [("a.py", "x\nz\n")]
    assert [(r.rel_path, r.status, r.message) for r in result.replaced.collect()] == [("b.py", "applied_ok", "verified")]
    assert result.rejects.isEmpty() and result.errors.isEmpty()


def _store(spark, tmp_path, contents):
    from folioflow import FileStore

    store = FileStore(spark, f"file://{tmp_path}/store")
    store.publish(_writes(spark, [(path, text, None) for path, text in contents.items()]), "s0")
    return store


def _writes(spark, rows):
    sha1 = lambda t: None if t is None else hashlib.sha1(t.encode()).hexdigest()
    return spark.createDataFrame([("p", path, new, sha1(base)) for path, new, base in rows], "project_id string, rel_path string, new_content string, base_sha1 string")


def _contents(store, upto=None):
    return {r.rel_path: r.content for r in store.read(upto).collect()}


def test_publish_checks_bases(spark, tmp_path):
    store = _store(spark, tmp_path, {"a.py": "a\n", "d/b.py": "b\n", "c.py": "c\n"})
    batch = _writes(spark, [("a.py", "A\n", "a\n"), ("d/b.py", "B\n", "other"), ("c.py", "C\n", None), ("new.py", "N\n", None), ("gone.py", "G", "was")])
    found = {r.rel_path: (r.status, r.version) for r in store.publish(batch, "s1").collect()}
    skipped = ("skipped_external_change", None)
    assert found == {"a.py": ("ok", 2), "d/b.py": skipped, "c.py": skipped, "new.py": ("ok", 2), "gone.py": skipped}
    assert _contents(store) == {"a.py": "A\n", "d/b.py": "b\n", "c.py": "c\n", "new.py": "N\n"}
    assert _contents(store, 1) == {"a.py": "a\n", "d/b.py": "b\n", "c.py": "c\n"}
    assert [(r.rel_path, r.backup_path, r.content) for r in store.backups().collect()] == [("a.py", "backups/a_s1.py", "a\n")]
    assert {r.status for r in store.publish(batch, "s2").collect()} == {"skipped_external_change"} and len(store.versions()) == 2
    with pytest.raises(ValueError, match="two contents"):
        store.publish(_writes(spark, [("a.py", "1", "A\n"), ("a.py", "2", "A\n")]), "s3")


def test_publish_against_a_faster_batch(spark, tmp_path, monkeypatch):
    """Another batch commits between the check and the commit: the check is made again."""
    from folioflow import FileStore

    store = _store(spark, tmp_path, {"a.py": "a\n", "b.py": "b\n"})
    record, others = FileStore._record, []

    def slow(self, version, folder):
        if not others:
            others.append(1)
            FileStore(spark, store.path).publish(_writes(spark, [("a.py", "faster\n", "a\n")]), "s1")
        return record(self, version, folder)

    monkeypatch.setattr(FileStore, "_record", slow)
    got = {r.rel_path: (r.status, r.version) for r in store.publish(_writes(spark, [("a.py", "A", "a\n"), ("b.py", "B", "b\n")]), "s2").collect()}
    assert got == {"a.py": ("skipped_external_change", None), "b.py": ("ok", 3)}
    assert _contents(store) == {"a.py": "faster\n", "b.py": "B"}
    folders = {p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("data-")}
    assert folders == set(store.versions().values()) and len(folders) == 3


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    from folioflow import FileStore

    store = _store(spark, tmp_path, {"a.py": "a\n"})
    bad = _writes(spark, [("a.py", "A", "a\n"), ("b.py", "B", None)])
    monkeypatch.setattr(FileStore, "_record", lambda *a: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError):
        store.publish(bad, "s1")
    monkeypatch.undo()
    assert _contents(store) == {"a.py": "a\n"} and store.backups().isEmpty()
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("data-")]) == 1
    assert {r.status for r in store.publish(bad, "s1").collect()} == {"ok"}


def test_edit_files_gates_and_writes(spark):
    files = spark.createDataFrame([(p, f, "x\ny\n") for p in "pq" for f in ("a.py", "b.py")], FILE)
    proposed = lambda path, text: f'<diff file="{path}">-y\n+{text}</diff><proposed_content file="{path}">x\n{text}</proposed_content>'
    responses = spark.createDataFrame([
        (1, "p", '[{"file": "a.py", "hunk": ["-y", "+z"], "context_before": ["x"]}]'),
        (2, "p", proposed("b.py", "first")), (3, "p", proposed("b.py", "second")),
        (4, "q", '[{"file": "a.py", "hunk": ["-y", "+z"], "context_before": ["x"]}]'),
        (5, "q", proposed("a.py", "other")), (6, "q", proposed("b.py", "other")),
    ], "response_id long, project_id string, text string")
    result = edit_files(responses, files)
    assert [tuple(r) for r in result.mixed.collect()] == [("q", "a.py")]
    base = hashlib.sha1(b"x\ny\n").hexdigest()
    assert {tuple(r) for r in result.writes.collect()} == {("p", "a.py", "x\nz\n", base), ("p", "b.py", "x\nsecond", base)}


@pytest.mark.parametrize("max_group_rows", [None, 1])
def test_overlaps_random(spark, max_group_rows):
    """A line claimed twice, whatever the lengths; empty blocks claim nothing."""
    rng = random.Random(3)
    rows, expected = [], set()
    for f in range(120):
        claims = [(rng.randrange(60), rng.choice([0, 1, 2, 5, 30])) for _ in range(rng.randrange(1, 6))]
        rows += [(f, i, "p", f"f{f}", ["-x"] * n, [], [], start, "matched") for i, (start, n) in enumerate(claims)]
        lines = [line for start, n in claims for line in range(start, start + n)]
        if len(lines) != len(set(lines)):
            expected.add(f"f{f}")
    located = spark.createDataFrame(rows, HUNKS.simpleString()[7:-1] + ", first_target_line:long, status:string")
    assert {r.rel_path for r in overlap_check(located, max_group_rows=max_group_rows).collect()} == expected
    huge = spark.sql("SELECT 1L AS response_id, 0 AS hunk_pos, 'p' AS project_id, 'a' AS rel_path, array_repeat('-x', 200000) AS hunk_lines, "
                     "cast(array() AS array<string>) AS context_before, cast(array() AS array<string>) AS context_after, 0L AS first_target_line, 'matched' AS status")
    assert overlap_check(huge).isEmpty()


def test_summary_lists_files_per_outcome(spark):
    rows = [
        ("p", "z.py", "skipped_unmatched", "m", None), ("p", "b.py", "skipped_unmatched", "m", None), ("p", "o.py", "skipped_overlap", "m", None),
        ("p", "e.py", "skipped_external_change", "m", None), ("p", "d.py", "applied_with_discrepancies", "m", None), ("p", "k.py", "ok", "m", 3),
        ("p", "f.py", "failed", "no content", None), ("p", "c.py", "failed_read", "gone", None), ("p", "n.py", "no_action", "m", None), ("q", "k.py", "ok", "m", 2),
    ]
    reports = spark.createDataFrame(rows, "project_id string, rel_path string, status string, message string, lines_applied long")
    p, q = (r.asDict() for r in apply_summary(reports).orderBy("project_id").collect())
    assert p == {
        "project_id": "p", "n_applicable": 9, "n_applied": 2, "lines_affected": 3,
        "n_unmatched": 2, "n_external": 1, "n_overlap": 1, "n_discrepancies": 1, "n_failed": 2,
        "unmatched_files": ["b.py", "z.py"], "external_files": ["e.py"], "overlap_files": ["o.py"], "discrepancies_files": ["d.py"],
        "failed_files": ["c.py (gone)", "f.py (no content)"],
    }
    assert q["n_applied"] == 1 and all(q[c] == [] for c in q if c.endswith("_files"))
