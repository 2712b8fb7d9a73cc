"""Every query with a SQL twin against DuckDB; the others by row count and schema."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle_check import differences, duck

HEAVY = {"report", "corpus_scores"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    assert differences(mine, con.execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - HEAVY))
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert {r["subset"] for r in entry.entry(spark).collect()} == {"all", "web", "desktop", "mobile"}


def test_report_covers_all_metrics(spark):
    rows = entry.queries()["report"](spark, SF).collect()
    got = {(r["subset"], r["metric"]): r["value"] for r in rows}
    assert len(got) == 4 * 19
    assert 0 <= got["all", "AUC"] <= 1 and 0 < got["all", "ss_score"] <= 1
