"""Lists of a batch of the graph, on one row or on several."""

from loomstone import catalog


def test_no_list_is_gathered(spark):
    """Fails where a nation's customers or an order's lines are collected in one task."""
    d = catalog.QUERIES["graph_increment"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in d._jdf.queryExecution().toString()
