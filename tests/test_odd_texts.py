"""Queries of hunks and responses where documents are empty or have no text."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle import compare

# Documents 0 to 11 are empty: one for each kind of response.
EMPTY = 12
# Their SQL says all of an empty document.
SAME = ["apply_proposed", "detect_format", "extract_json_hunks", "original_lines", "stream_suggestions", "union_changes"]
# Their SQL finds a line in an empty file, where there is none to replace.
NO_PLACE = {
    "candidate_starts": "false",
    "best_match": "first_target_line IS NULL AND n_best = 0",
    "annotate_hunk": "label = 'error-message' AND line_no < 3",
    "publish_edits": "coalesce(status, 'ok') IN ('ok', 'skipped_unmatched', 'skipped_external_change')",
    # A line break and a line are put into an empty file, more than the claim says.
    "verify_applied": "status = CASE WHEN response_id % 7 = 4 THEN 'failed' WHEN response_id % 7 IN (3, 5) THEN 'applied_ok' ELSE 'applied_with_discrepancies' END",
}


def documents(path, texts) -> str:
    rows = [{"doc_id": i, "text": text, "lang": ["en", "fr"][i % 2], "source": f"src{i % 3}", "n_chars": len(text or "")} for i, text in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(rows), path / "documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    texts = [""] * EMPTY + [f"one {i}" for i in range(12)] + [f"a {i}\nb\n\nc" for i in range(12)]
    return documents(tmp_path_factory.mktemp("odd"), texts)


@pytest.mark.parametrize("name", SAME)
def test_empty_documents_agree_with_sql(spark, odd, name):
    assert compare(spark, odd, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(NO_PLACE))
def test_empty_documents_have_no_place(spark, odd, name):
    whole = queries()[name](spark, odd).cache()
    number = "response_id" if "response_id" in whole.columns else "cast(regexp_extract(rel_path, '[dp]([0-9]+)[./]', 1) AS bigint)"
    assert whole.filter(f"{number} < {EMPTY}").filter(f"NOT ({NO_PLACE[name]})").isEmpty()
    if name in ("best_match", "publish_edits", "verify_applied"):
        assert whole.filter(f"{number} < {EMPTY}").count() == EMPTY
    others = f"SELECT * FROM ({oracle_sql()[name]}) WHERE {number} >= {EMPTY}"
    assert compare(spark, odd, lambda *_: whole.filter(f"{number} >= {EMPTY}"), others) is None


def test_sequence_ratio_of_odd_texts(spark, odd, tmp_path):
    assert compare(spark, odd, queries()["sequence_ratio"], oracle_sql()["sequence_ratio"]) is None
    folder = documents(tmp_path, ["", None, "one", "a\nb"])
    rows = queries()["sequence_ratio"](spark, folder).orderBy("doc_id").collect()
    assert [r.ratio for r in rows] == [0.0, None, 0.0, 0.5]
