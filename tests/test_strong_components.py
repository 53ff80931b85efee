import pytest

from corpusloom.operators import graph


def chain(spark, n):
    """Components of two nodes, each leading to the next."""
    edges = [(2 * k, 2 * k + 1) for k in range(n)] + [(2 * k + 1, 2 * k) for k in range(n)] + [(2 * k + 1, 2 * k + 2) for k in range(n - 1)]
    return spark.createDataFrame([(k,) for k in range(2 * n)], "id long"), spark.createDataFrame(edges, "subject long, object long")


def test_chain_in_order_of_id_is_whole(spark):
    found = {r.id: r.component for r in graph.strong_components(*chain(spark, 12), max_rounds=9).collect()}
    assert found == {k: k - k % 2 for k in range(24)}


def test_rounds_that_run_out_raise(spark):
    with pytest.raises(RuntimeError):
        graph.strong_components(*chain(spark, 4), max_rounds=1)
