"""The cycle rules over all dependencies."""

from lattiq.operators.graphs import Graph
from lattiq.queries import QUERIES, WITH
from tests.test_queries import DIR, duck  # noqa: F401


def test_no_query_reads_a_subset():
    """The relations under the queries have no filter but those that define them."""
    from lattiq.queries import SQL

    assert not [n for n, sql in SQL.items() if "event_id %" in sql or "discount >= 0.06" in sql or "discount >= 0.05" in sql]
    assert not [n for n in QUERIES if n.startswith("whole_")]


def test_cycle_rules_see_all_dependencies(spark, duck):  # noqa: F811
    edges = set(duck.execute(f"{WITH} SELECT DISTINCT f, t FROM deps WHERE kind != 'TypeOnly'").fetchall())
    got = [r.path.split(" -> ") for r in QUERIES["circular_dependencies"](spark, DIR).collect()]
    assert sorted(got) == sorted(Graph([], edges).cycles())
    assert all(set(zip(c, c[1:], strict=False)) <= edges for c in (r.path.split(" -> ") for r in QUERIES["runtime_cycles"](spark, DIR).collect()))
