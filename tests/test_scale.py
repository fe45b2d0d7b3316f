"""What must not grow faster than the input: how often edges are made, and what passes through the driver."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lattiq import ingest_queries, queries
from lattiq.config import from_dict
from lattiq.functions.hashes import fnv1a, fnv1a_text
from lattiq.operators import graphs, resolve, rules
from lattiq.plans import restore
from lattiq.plans.store import Store
from lattiq.schemas import LOCATION, MANIFESTS
from lattiq.sources import repository
from lattiq.storage import shuffled, sized


def counted(spark, pairs):
    """Edges that count how often a row is made."""
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            made.add(len(f))
            yield f

    return spark.createDataFrame(pairs, "`from` string, `to` string").mapInPandas(run, "`from` string, `to` string"), made


def test_many_rows_in_small_files_are_not_broadcast(spark):
    rows = spark.range(50).select("id", F.lit("same").alias("x"))
    plan = rows.join(sized(rows.withColumnRenamed("x", "y"), limit=10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" in rows.join(sized(rows.withColumnRenamed("x", "y")), "id")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("work", ["spread", "cycles"])
def test_edges_are_made_once(spark, work):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")]
    edges, made = counted(spark, pairs)
    if work == "spread":
        seeds = spark.createDataFrame([("s", "a"), ("s", "z")], "label string, node string")
        got = {(r.node, r.dist, r.via, tuple(r.path)) for r in graphs.spread(edges, seeds, mode="distributed").collect()}
        assert got == {("a", 0, None, ("a",)), ("z", 0, None, ("z",)), ("b", 1, "a", ("a", "b")), ("c", 2, "b", ("a", "b", "c")), ("d", 3, "c", ("a", "b", "c", "d"))}
    else:
        assert {(tuple(r.cycle), r["size"]) for r in graphs.cycles(edges, mode="distributed").collect()} == {(("a", "b", "c", "a"), 3), (("d", "d"), 1)}
    assert made.value == len(pairs)


@pytest.mark.parametrize("work", [graphs.cycles, graphs.components])
def test_edges_are_made_before_they_are_counted(spark, work, monkeypatch):
    monkeypatch.setattr(graphs, "is_small", lambda edges: graphs.LOCAL_EDGES > edges.count() > 2)
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "d")]
    edges, made = counted(spark, pairs)
    assert work(edges).count() == (2 if work is graphs.cycles else 4)
    assert made.value == len(pairs)


def test_nodes_that_go_do_not_move_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "`from` long, `to` long")
    plan = graphs.without(edges, spark.createDataFrame([(3,)], "node long"), 1)
    assert sorted(r[0] for r in plan.collect()) == [i for i in range(20) if i not in (2, 3)]
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_text_is_hashed_in_one_pass(spark):
    df = spark.createDataFrame([("aä|b",), ("",), (None,)], "x string")
    made = df.select(fnv1a(F.concat("x", F.lit("|y"))).alias("h"))
    assert [r.h for r in made.collect()] == [fnv1a_text("aä|b|y"), fnv1a_text("|y"), fnv1a_text("")]
    assert made._jdf.queryExecution().analyzed().toString().count("concat(x") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_one_rule_spreads_from_its_own_targets_alone(spark, monkeypatch):
    seen, spread = [], graphs.spread
    monkeypatch.setattr(graphs, "spread", lambda edges, seeds, *a, **k: seen.append({r.label for r in seeds.select("label").distinct().collect()}) or spread(edges, seeds, *a, **k))
    c = queries.context(spark, "/root/testdata/sf0.001")
    rules.browser_to_server(c)
    rules.edge_runtime(c)
    assert seen[0] == {"server"} and seen[1] <= {"node", "edge-packages"}


def test_tries_are_few_and_find_every_probe(spark):
    bases = ["src/a", "src/a.js", "src/a.b.mjs", "", "x/.cjs", "lib/index", "a.css"]
    tries = spark.createDataFrame([(i, b, False) for i, b in enumerate(bases)], "request int, base string, strict boolean").withColumn("key", F.explode(resolve.sought(F.col("base")))).cache()
    probes = {(i, p) for i, b in enumerate(bases) for p in resolve.probes(b)}
    files = spark.createDataFrame([(p,) for p in sorted({p for _, p in probes} | {"src", "src/a.txt", "index"})], "path string")
    got = {(r.request, r.path, r.k) for r in resolve.tried(tries, resolve.offered(files)).collect()}
    assert got == {(i, p, resolve.probes(bases[i]).index(p) + 1) for i, p in probes}
    assert tries.count() <= 2 * len(bases)


def planned(spark, monkeypatch, module, run):
    """What ``run`` returns, and the joins of each table that ``module`` writes by name, where no lookup counts as small."""
    plans, write = {}, module.written
    joins = lambda df: set(re.findall(r"BroadcastHashJoin|SortMergeJoin", df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(module, "written", lambda df, name: plans.setdefault(name, set()).update(joins(df)) or write(df, name))
    for m in {resolve, queries, module}:
        monkeypatch.setattr(m, "sized", shuffled)
    out = run()
    return out, plans | {"": joins(out)}


def test_requests_are_joined_by_shuffle(spark, monkeypatch):
    imports = spark.createDataFrame([("src/a.ts", s, "Static", None, i) for i, s in enumerate(["./b", "./none", "@/b", "#in", "@w/p", "@w/p/x", "fs", "lib/y"])], f"module_id string, specifier string, kind string, location {LOCATION}, ord long")
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b.ts", "p/main.ts")], "path string")
    manifests = spark.createDataFrame([("", "root", '{"imports":{"#in":"./src/b.ts"}}'), ("p", "@w/p", '{"exports":{".":"./main.ts"}}')], MANIFESTS)
    settings = repository.tsconfigs(spark, spark.createDataFrame([("tsconfig.json", '{"compilerOptions":{"paths":{"@/*":["src/*"]}}}')], "path string, source string"))
    scopes = spark.createDataFrame([], "directory string, type string")
    out, plans = planned(spark, monkeypatch, resolve, lambda: resolve.resolve(imports, files, manifests, settings, scopes, from_dict({"version": 1})))
    assert not [n for n in ("bases", "final", "tries", "rest", "") if "BroadcastHashJoin" in plans[n]]
    assert {r.specifier: r.value for r in out.collect()} == {"./b": "src/b.ts", "./none": "", "@/b": "src/b.ts", "#in": "src/b.ts", "@w/p": "p/main.ts", "@w/p/x": "", "fs": "node:fs", "lib/y": "lib"}


def test_kept_tables_are_joined_by_shuffle(spark, monkeypatch, tmp_path):
    at = lambda *names: spark.createDataFrame([(f"src/{n}.ts",) for n in names], "path string")
    imports = spark.createDataFrame([(f"src/{n}.ts", f"./{s}", "Static", None, i) for i, (n, s) in enumerate([("a", "b"), ("a", "c"), ("b", "d")])], f"module_id string, specifier string, kind string, location {LOCATION}, ord long")
    none = [spark.createDataFrame([], x) for x in (MANIFESTS, "directory string, base_url string, resolve_bare boolean, aliases array<struct<pattern:string,targets:array<string>>>", "directory string, type string")]
    run = lambda store, i, f: restore.restored(store, i, f, *none, from_dict({"version": 1}), "e")[0]
    store = Store(spark, f"file://{tmp_path}/kept")
    run(store, imports.where("ord < 2"), at("a", "b", "d"))
    out, plans = planned(spark, monkeypatch, restore, lambda: run(store, imports, at("a", "c", "d")))
    assert not [n for n in ("changed", "fresh") if "BroadcastHashJoin" in plans[n]]
    assert {r.specifier: r.value for r in out.collect()} == {"./b": "", "./c": "src/c.ts", "./d": "src/d.ts"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_packages_of_targets_are_joined_by_shuffle(spark, monkeypatch):
    _, plans = planned(spark, monkeypatch, ingest_queries, lambda: ingest_queries.workspace_resolution(spark, "/root/testdata/sf0.001"))
    assert plans["imports"] == {"SortMergeJoin"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_all_diagnostics_asks_every_rule(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(rules, "EVALUATORS", {r: lambda c, r=r: asked.append(r) or rules.none(c) for r in rules.EVALUATORS})
    queries.all_diagnostics(spark, "/root/testdata/sf0.001")
    assert set(asked) == set(rules.EVALUATORS)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_all_diagnostics_has_what_graph_rules_find(spark):
    c = queries.context(spark, "/root/testdata/sf0.001", keep=True)
    want = {r: {tuple(x.dependency_path) for x in f(c).collect()} for r, f in rules.EVALUATORS.items() if r in ("ARCH-001", "ARCH-006", "PACKAGE-001", "RUNTIME-001")}
    got = {}
    for x in queries.all_diagnostics(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(x.rule_id, set()).add(tuple(x.path.split(" -> ")))
    assert want["ARCH-001"] and want["RUNTIME-001"]
    assert {r: got.get(r, set()) for r in want} == want
