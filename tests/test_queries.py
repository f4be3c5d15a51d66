"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare

ORACLES = oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, folder, name):
    assert compare(spark, folder, queries()[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_gives_rows(spark, folder, name):
    assert queries()[name](spark, folder).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 20
    assert all(r.prompt_text.startswith("<instructions>\n") and r.prompt_text.endswith("</context>") for r in rows)
