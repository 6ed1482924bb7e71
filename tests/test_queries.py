"""Every core query against its SQL on the smallest tables, or that it gives rows."""

import inspect

import oracle
import pytest

from mundspark.operators import features
from mundspark.plans import catalogue

NAMES = [(n, n in m.SQL) for m in catalogue.MODULES for n in m.QUERIES]


@pytest.mark.parametrize("name,has_sql", NAMES)
def test_query(spark, name, has_sql):
    if has_sql:
        oracle.compare(spark, name)
    else:
        import __spark_entry__ as entry

        assert entry.queries()[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


class Called(Exception):
    pass


def arguments(query, spark, monkeypatch, name):
    """The arguments, defaults included, with which a query first calls a function of features."""
    signature = inspect.signature(getattr(features, name))

    def stop(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(features, name, stop)
    with pytest.raises(Called) as e:
        query(spark, oracle.SF)
    return e.value.args[0]


@pytest.mark.parametrize("name", ["tfidf_rows", "bayes_labels", "two_stage_labels", "linear_labels", "neighbour_errors", "speaker_probabilities"])
def test_whole_vectoriser(spark, monkeypatch, name):
    query = next(m.QUERIES[name] for m in catalogue.MODULES if name in m.QUERIES)
    assert arguments(query, spark, monkeypatch, "term_arrays")["sizes"] == (2, 3, 4)


def test_whole_linear_model(spark, monkeypatch):
    query = next(m.QUERIES["linear_labels"] for m in catalogue.MODULES if "linear_labels" in m.QUERIES)
    a = arguments(query, spark, monkeypatch, "linear_model")
    assert (a["features"], a["iterations"]) == (1 << 18, 50)
