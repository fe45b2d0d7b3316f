import random

import pytest

from lattiq.operators import graphs
from lattiq.operators.graphs import Graph
from lattiq.storage import written


def frame(spark, edges):
    return spark.createDataFrame(edges, "`from` string, `to` string")


def closure(nodes, edges):
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for i in nodes:
            if k in reach[i]:
                reach[i] |= reach[k]
    return reach


def test_random_graphs_against_closure():
    rng = random.Random(5)
    for _ in range(40):
        nodes = [f"n{i:02d}" for i in range(24)]
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randint(5, 60))]
        g, reach = Graph(nodes, edges), closure(nodes, edges)
        for n in nodes[:6]:
            assert set(g.spread([n])) == reach[n] | {n}
        parts = {frozenset(c) for c in g.components()}
        assert parts == {frozenset({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes}
        for cycle in g.cycles():
            assert cycle[0] == cycle[-1]
            assert all((a, b) in edges for a, b in zip(cycle, cycle[1:], strict=False))
        assert len(g.cycles()) == sum(any(n in reach[n] for n in c) for c in parts)


def test_first_in_first_out_and_first_discovered():
    g = Graph([], [("b", "a"), ("a", "b"), ("0", "b")])
    assert g.cycles() == [["b", "a", "b"]]  # found from 0, so b comes first
    assert g.chain(g.spread(["0"]), "a") == ["a", "b", "0"]


def test_long_chain_of_10000():
    g = Graph([], [(f"{i:05d}", f"{i + 1:05d}") for i in range(10_000)])
    assert len(g.components()) == 10_001
    assert g.cycles() == []


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("y", "z"), ("a", "c")]


@pytest.mark.parametrize("mode", ["local", "distributed"])
def test_components_cycles_and_paths(spark, mode):
    e = frame(spark, EDGES)
    assert {r.node: r.scc for r in graphs.components(e, mode).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "x": "x", "y": "y", "z": "z"}
    assert sorted(r.cycle for r in graphs.cycles(e, mode).collect()) == [["a", "b", "c", "a"], ["d", "e", "d"], ["x", "x"]]
    assert graphs.shortest_path(e, "a", "e", mode).first().path == ["a", "c", "d", "e"]


@pytest.mark.parametrize("mode", ["local", "distributed"])
def test_spread_labels_boundaries_and_direction(spark, mode):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("q", "c")])
    seeds = spark.createDataFrame([("one", "d"), ("two", "b"), ("none", "lost")], "label string, node string")
    shut = spark.createDataFrame([("c",)], "node string")
    got = {(r.label, r.node): (r.dist, r.path) for r in graphs.spread(e, seeds, shut, back=True, mode=mode).collect()}
    assert got == {("one", "d"): (0, ["d"]), ("one", "c"): (1, ["c", "d"]), ("two", "b"): (0, ["b"]), ("two", "a"): (1, ["a", "b"]), ("none", "lost"): (0, ["lost"])}


def test_modes_agree_on_random_graphs(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(15)]
    e = frame(spark, [(rng.choice(nodes), rng.choice(nodes)) for _ in range(25)])
    seeds = spark.createDataFrame([("s", "n1"), ("s", "n2")], "label string, node string")
    both = [sorted((r.node, r.dist, r.path) for r in graphs.spread(e, seeds, mode=m).collect()) for m in ("local", "distributed")]
    assert both[0] == both[1]


def test_empty_graph(spark):
    e = frame(spark, [])
    assert graphs.cycles(e).count() == 0
    assert graphs.degrees(e).count() == 0


def test_modes_agree_on_cyclic_components_of_random_graphs(spark):
    rng, edges = random.Random(11), set()
    for g in range(12):  # graphs apart from each other, in one run
        nodes = [f"g{g:02d}n{i:02d}" for i in range(10)]
        edges |= {(rng.choice(nodes), rng.choice(nodes)) for _ in range(14)}
    e = frame(spark, sorted(edges))
    of = {n: min(c) for c in Graph([], edges).components() for n in c}
    found = {}
    for mode in ("local", "distributed"):
        rows = graphs.cycles(e, mode).collect()
        assert all(r.cycle[0] == r.cycle[-1] and set(zip(r.cycle, r.cycle[1:], strict=False)) <= edges for r in rows)
        found[mode] = {of[r.cycle[0]]: (r.size, r.cycle) for r in rows}
        assert len(found[mode]) == len(rows)
    assert {k: v[0] for k, v in found["local"].items()} == {k: v[0] for k, v in found["distributed"].items()}


def test_long_chain_and_reachability(spark):
    names = [f"n{i:03d}" for i in range(25)]
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "`from` string, to string")
    seeds = spark.createDataFrame([("s", names[0])], "label string, node string")
    got = {r.node: (r.dist, r.path) for r in graphs.spread(edges, seeds, mode="distributed").collect()}
    assert got == {n: (i, names[: i + 1]) for i, n in enumerate(names)}
    assert graphs.reachable_from(edges, names[20]).count() == 4
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    assert graphs.has_path(edges, nodes, names[3], names[9]) and not graphs.has_path(edges, nodes, names[9], names[3])
    assert graphs.has_path(edges, nodes, names[3], names[3]) and not graphs.has_path(edges, nodes, "none", "none")


def test_components_of_long_rings_and_chains(spark, monkeypatch):
    """Rounds grow with the logarithm of a ring's length; chains between, into and out of components are whole."""
    n = 3000
    ring = [(f"r{i:05d}", f"r{(i + 1) % n:05d}") for i in range(n)]
    tail = [(f"t{i:05d}", f"t{i + 1:05d}") for i in range(500)] + [("t00500", "r00007"), ("r00009", "z0")]
    ear = [("r00100", "e0"), *((f"e{i}", f"e{i + 1}") for i in range(40)), ("e40", "r00050"), ("a", "b"), ("b", "a")]
    rounds = []
    monkeypatch.setattr(graphs, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    e = frame(spark, ring + tail + ear)
    got = {r.node: r.scc for r in graphs.components(e, "distributed").collect()}
    assert got == {r.node: r.scc for r in graphs.components(e, "local").collect()}
    assert len(rounds) < 60
    rounds.clear()
    only = graphs.components(frame(spark, ring), "distributed")
    assert {r.scc for r in only.select("scc").distinct().collect()} == {"r00000"} and len(rounds) <= 24


def test_components_agree_on_random_graphs(spark):
    rng, edges = random.Random(5), set()
    for g in range(40):
        size, out = rng.choice([(6, 7), (12, 13), (20, 24), (9, 20)])
        nodes = [f"g{g:02d}n{i:02d}" for i in range(size)]
        edges |= {(rng.choice(nodes), rng.choice(nodes)) for _ in range(out)}
    e = frame(spark, sorted(edges))
    assert sorted(graphs.components(e, "distributed").collect()) == sorted(graphs.components(e, "local").collect())


def test_paths_by_doubling_of_several_seeds(spark):
    rng = random.Random(9)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(a, b) for a, b in zip(nodes, nodes[1:])] + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(10)]
    seeds = spark.createDataFrame([("s", "n00"), ("s", "n20"), ("t", "n39")], "label string, node string")
    for back in (False, True):
        both = [sorted((r.label, r.node, r.dist, r.via, r.path) for r in graphs.spread(frame(spark, edges), seeds, back=back, mode=m).collect()) for m in ("local", "distributed")]
        assert [[(*r[:3], r[4]) for r in b] for b in both][0] == [[(*r[:3], r[4]) for r in b] for b in both][1]
