"""Every query of the library next to its SQL, over whole tables."""

import pytest
from compare import same

import __spark_entry__ as entry
from juryframe.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, folder, name):
    out = QUERIES[name](spark, folder)
    if name in ORACLES:
        same(out, ORACLES[name], folder)
    else:
        assert out.columns and out.count() >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_training_data_queries_come_with_their_package():
    try:
        import corpus_pipeline  # noqa: F401
        import juryframe.llm  # noqa: F401
    except ModuleNotFoundError:
        assert set(entry.queries()) == set(QUERIES)
    else:
        assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()
