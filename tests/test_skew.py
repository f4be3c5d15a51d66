"""The ways around hot keys give what the plain operators give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import context as C
from folioflow.operators.skew import hot_keys, lookup_join, running_rank, running_total, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.34 else f"g{rng.randrange(40)}", i, rng.randrange(10)) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, i int, v int").repartition(6).cache()


@pytest.mark.parametrize("limit", [0, 100, 10**6])
def test_running_total(skewed, limit):
    got = running_total(skewed, ["g"], ["i"], {"upto": "v"}, max_group_rows=limit).collect()
    sums: dict[str, int] = {}
    expected = {}
    for r in sorted(skewed.collect(), key=lambda r: r.i):
        sums[r.g] = expected[r.i] = sums.get(r.g, 0) + r.v
    expected = {}
    sums = {}
    for r in sorted(skewed.collect(), key=lambda r: (r.g, r.i)):
        sums[r.g] = sums.get(r.g, 0) + r.v
        expected[r.i] = sums[r.g]
    assert {r.i: r.upto for r in got} == expected
    assert len(got) == 3000


def test_running_rank(skewed):
    plain = running_rank(skewed, ["g"], [F.col("v").desc(), "i"], "pos")
    blocks = running_rank(skewed, ["g"], [F.col("v").desc(), "i"], "pos", max_group_rows=0)
    assert plain.exceptAll(blocks).isEmpty() and blocks.exceptAll(plain).isEmpty()


def test_hot_keys(skewed):
    rows = hot_keys(skewed, ["g"], rows_per_salt=200).collect()
    assert [r.g for r in rows] == ["hot"] and rows[0]._pieces >= 5


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("redistribute", [False, True])
def test_skew_join(spark, skewed, how, redistribute):
    one = spark.createDataFrame([("hot", 1), *[(f"g{i}", i) for i in range(30)]], "g string, w int")
    salted = skew_join(skewed, one, ["g"], how, ["i"], rows_per_salt=20, redistribute=redistribute)
    plain = skewed.join(one, ["g"], how)
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_skew_join_refuses_outer(skewed):
    with pytest.raises(ValueError):
        skew_join(skewed, skewed, ["g"], "full", ["i"])


def test_large_lookup_is_not_broadcast(spark, skewed, monkeypatch):
    import folioflow.operators.skew as skew

    one = spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, w int")
    small = lookup_join(skewed, one, ["g"], "left", ["i"])
    assert skew.is_small(one)
    monkeypatch.setattr(skew, "MAX_LOOKUP_BYTES", 5)
    assert not skew.is_small(one)
    monkeypatch.setattr(skew, "MAX_LOOKUP_ROWS", 1)
    large = lookup_join(skewed, one, ["g"], "left", ["i"])
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


def _context_files(spark):
    rows = [("p", f"d{i % 3}/f{i:02}.py", "x<&" * i, 3 * i, i + 1, "read_ok") for i in range(30)] + [("q", "a.py", "y", 1, 1, "read_ok")]
    return spark.createDataFrame(rows, "project_id string, rel_path string, content string, size long, tokens long, status string")


def test_parts_concatenate_to_the_document(spark):
    files = _context_files(spark)
    whole = {r.project_id: r.context_xml for r in C.assemble_context(files).collect()}
    parts = C.assemble_context(files, max_part_chars=100, max_group_rows=0).orderBy("project_id", "part_no").collect()
    assert sum(r.project_id == "p" for r in parts) > 3
    assert {p: "".join(r.context_xml for r in parts if r.project_id == p) for p in ("p", "q")} == whole
    segments = C.context_segments(files).orderBy("project_id", "seq", "parts").collect()
    assert {p: "".join(r.text for r in segments if r.project_id == p) for p in ("p", "q")} == whole


def test_document_layout(spark):
    files = _context_files(spark).filter("project_id = 'q' OR rel_path = 'd1/f01.py'")
    rows = {r.project_id: r.context_xml for r in C.assemble_context(files).collect()}
    assert rows["q"] == "<context>\n    <file name='a.py' module='\\'>\ny\n    </file>\n</context>"
    assert rows["p"] == "<context>\n    <file name='f01.py' module='d1\\'>\nx&lt;&amp;\n    </file>\n</context>"


def test_all_skipped_gives_an_empty_document(spark):
    files = _context_files(spark)
    nothing = C.apply_budget(files, 0, enforce=True)
    assert {r.context_xml for r in C.assemble_context(nothing).collect()} == {"<context>\n</context>"}


@pytest.mark.parametrize("limit", [0, 1, 7, 100, 10**6])
def test_budget_keeps_the_longest_prefix(spark, limit):
    files = _context_files(spark)
    marked = C.apply_budget(files, limit, enforce=True).collect()
    for project in ("p", "q"):
        rows = sorted((r for r in marked if r.project_id == project), key=lambda r: r.rel_path.split("/"))
        total = 0
        for r in rows:
            total += r.tokens
            assert (r.status == "skipped_budget") == (total > limit)
    totals = C.total_tokens(C.apply_budget(files, limit, enforce=True)).collect()
    assert sum(r.n_included + r.n_skipped for r in totals) == files.count()


def test_budget_is_not_enforced_by_default(spark):
    files = _context_files(spark)
    assert C.apply_budget(files, 1).filter("status LIKE 'skipped%'").isEmpty()
