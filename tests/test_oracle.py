"""Every query with SQL gives the same rows in DuckDB; the others give some."""

import pytest

from conftest import SF_DIR
from oracle import compare
from cohortloom.plans.registry import all_queries

ALL = all_queries()


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if q.sql])
def test_matches_sql(spark, con, name):
    compare(ALL[name].run(spark, SF_DIR), con, ALL[name].sql)


@pytest.mark.parametrize("name", ["diff_moderated", "diff_selected_matrix", "book_search",
                                  "chapter_docs_clean", "full_book", "predict_final",
                                  "node_training_stats", "project_missing", "svm_cv",
                                  "neighbourhood_projection"])
def test_gives_rows(spark, name):
    assert ALL[name].run(spark, SF_DIR).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
