"""Every query of the engine against its SQL, over the smallest tables."""

import pytest

from answerloom.plans.catalog import QUERIES, SQL
from tests.compare import same

SLOW = {"svm_classify", "answer_pipeline_m2"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, sf_dir, duck):
    same(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["qid", "doc_id", "passage", "score", "rank"]
