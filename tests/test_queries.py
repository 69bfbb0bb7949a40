"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01), plus the driver contract."""

import pytest

import __spark_entry__ as E
from pagemill.plans.catalog import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["ok"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["id", "content"]


def test_rate_flag_matches_recorded_figures(spark):
    """W1 at sf0.01 (window 86,400 s, limit 4): 10,000 rows, 31,982 summed
    """
    from pyspark.sql import functions as F

    from tests.conftest import SF_MID
    r = E.queries()["rate_flag"](spark, SF_MID).agg(
        F.count(F.lit(1)), F.sum("n_in_window"), F.count_if("flagged")).first()
    assert tuple(r) == (10000, 31982, 1860)


def test_quality_and_space_figures_match_recorded(spark):
    """Readability saturates (996 of 1,000 documents score 100, SURVEY D16/V17);
    space sizes 150 / 37 / 37 / 26 (FIXTURES, wiki_pages adapter)."""
    from pyspark.sql import functions as F

    from tests.conftest import SF_MID
    q = E.queries()
    assert q["document_quality"](spark, SF_MID).agg(F.count_if(F.col("readability") == 100)).first()[0] == 996
    sizes = {r.space_key: r.total_pages for r in q["space_summary"](spark, SF_MID).collect()}
    assert sizes == {"en": 150, "fr": 37, "de": 37, "es": 26}
