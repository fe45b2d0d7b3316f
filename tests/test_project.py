import json
import os

import pytest
from pyspark.sql import functions as F

from lattiq import cli, config
from lattiq.operators import diagnostics, resolve, views
from lattiq.plans import analyze, incremental, restore
from lattiq.plans.store import Store
from lattiq.sources import repository, sinks

FILES = {
    "package.json": json.dumps({"name": "root", "workspaces": ["packages/*"]}),
    "packages/ui/package.json": json.dumps({"name": "@t/ui"}),
    "packages/web/package.json": json.dumps({"name": "@t/web", "dependencies": {"next": "15.0.0"}}),
    "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["packages/web/src/*"],}} }',
    "packages/ui/src/index.ts": 'import { a } from "../../web/src/shared/a";\nexport const ui = a;\n',
    "packages/web/src/app/page.tsx": '"use client";\nimport { db } from "~/server/db";\nimport { ui } from "@t/ui";\nimport lost from "./lost";\n',
    "packages/web/src/server/db.ts": 'import "server-only";\nimport fs from "fs";\nexport const db = fs;\n',
    "packages/web/src/shared/a.ts": '// lattiq-ignore ARCH-001 -- known\nimport { b } from "./b";\nexport const a = b;\n',
    "packages/web/src/shared/b.ts": 'import { a } from "./a";\nexport const b = a;\n',
    "packages/web/src/shared/broken.ts": "const x = (\n",
    "packages/web/src/shared/c.ts": "// lattiq-ignore ARCH-002 -- nothing here\nexport const c = 1;\n",
    "packages/web/src/pages/_app.tsx": "export default 1;\n",
    "ignored/x.ts": "import './nowhere';\n",
    ".gitignore": "ignored/\n",
}
CONFIG = {"resolution": {"mode": "bundler"}, "architecture": {"layers": {"web": {"patterns": ["packages/web/**"]}, "ui": {"patterns": ["packages/ui/**"]}}}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)
    (at / "lattiq.json").write_text(json.dumps(CONFIG))
    return str(at)


@pytest.fixture(scope="module")
def done(spark, root):
    return analyze.check(spark, root, config.from_dict(CONFIG))


def found(a):
    return {(r.rule_id, r.suppressed, r.message) for r in a.diagnostics.collect()}


def test_every_kind_of_diagnostic(done):
    got = found(done)
    by = {(r, s) for r, s, _ in got}
    assert {("ARCH-001", True), ("ARCH-003", False), ("PACKAGE-001", False), ("PACKAGE-003", False), ("PACKAGE-004", False), ("RUNTIME-001", False), ("RUNTIME-002", False), ("PARSE-001", False), ("RESOLVE-001", False), ("SUPPRESS-001", False)} <= by
    assert ("RESOLVE-001", False, "Cannot resolve `./lost`") in got
    assert not any("nowhere" in m for _, _, m in got)


def test_order_and_fingerprints_are_stable(spark, root, done):
    again = analyze.check(spark, root, config.from_dict(CONFIG), mode="distributed")
    key = lambda a: sorted((r.rule_id, r.fingerprint) for r in a.diagnostics.collect())
    assert key(again) == key(done)


def test_modules(done):
    kinds = {r.kind: r.modules for r in views.counts_by_kind(done.frames.modules).collect()}
    assert kinds == {"source": 8, "external": 2}
    web = done.frames.modules.where("id = 'packages/web/src/app/page.tsx'").first()
    assert (web.package, web.runtime, web.framework.attributes["runtimeSource"]) == ("@t/web", "browser", "directive")


def test_reports(done):
    doc = json.loads(sinks.to_json(done))
    assert doc["modules"]["source"] == 8
    assert doc["policy"]["failed"]
    sarif = json.loads(sinks.to_sarif(done))
    assert len(sarif["runs"][0]["results"]) == len(doc["diagnostics"]) == len(sinks.to_jsonl(done).splitlines()) - 1
    assert any(r.get("suppressions") for r in sarif["runs"][0]["results"])
    assert "ARCH-003" in sinks.to_text(done)
    assert "</script><script>" in sinks.to_html(done)
    assert sinks.annotations(done.diagnostics, 2).count() == 2
    assert "| error |" in sinks.summary_table(done.diagnostics)


def test_baseline_and_regression(spark, done):
    base = diagnostics.to_baseline(done.diagnostics).where("rule_id != 'ARCH-003'")
    row = diagnostics.regression_summary(done.diagnostics, base).first()
    new = done.diagnostics.where("rule_id = 'ARCH-003'").count()
    assert (row.introduced, row.fixed) == (new, 0)
    assert diagnostics.in_baseline(done.diagnostics.where("not suppressed"), base).count() == row.existing


def test_views(spark, done):
    f = done.frames
    changes = spark.createDataFrame([("packages/web/src/shared/b.ts", "M")], "path string, status string")
    assert {r.path.rsplit("/", 1)[1] for r in views.impact(f, changes).collect()} == {"a.ts", "b.ts", "index.ts", "page.tsx"}
    lost = spark.createDataFrame([("packages/web/src/app/lost.ts", "D")], "path string, status string")
    assert {r.path.rsplit("/", 1)[1] for r in views.impact(f, lost).collect()} == {"page.tsx"}
    a, b = "packages/ui/src/index.ts", "packages/web/src/shared/a.ts"
    assert views.dependency_policy(f, done.diagnostics, a, b).first().verdict == "denied"
    c = "packages/web/src/shared/c.ts"
    assert views.dependency_policy(f, done.diagnostics, c, b).first().verdict == "indeterminate"
    assert views.dependency_path(f, a, "packages/web/src/shared/b.ts").first().dist == 2
    assert set(views.inspect(f, done.diagnostics, b)) == {"module", "edges", "diagnostics"}
    assert views.overview(f, done.diagnostics).count() > 5


def test_config_suppressions(done):
    c = config.from_dict(CONFIG | {"suppressions": {"paths": [{"pattern": "packages/ui/*", "rules": ["ARCH-003"], "reason": "later"}, {"pattern": "zz", "rules": ["ARCH-003"], "reason": "r"}], "fingerprints": [{"fingerprint": "0", "reason": "old", "expires_at": "2020-01-01"}]}})
    out = diagnostics.suppress_by_config(done.diagnostics.where("rule_id = 'ARCH-003'"), c)
    rows = out.collect()
    hit = [r for r in rows if r.rule_id == "ARCH-003"]
    assert hit and all(r.suppressed and r.metadata["suppression.kind"] == "path" for r in hit)
    assert sorted(r.message for r in rows if r.rule_id == "SUPPRESS-001") == ["Expired fingerprint suppression `0`", "Unused path suppression `zz`"]


def test_incremental_equals_full(spark, done):
    cache = incremental.RuleCache()
    c = config.from_dict(CONFIG)
    first, s1 = incremental.reanalyze(done.frames, c, cache)
    again, s2 = incremental.reanalyze(done.frames, c, cache)
    assert (s1.rules_full, s2.rules_reused) == (21, 21)
    assert found(again) == found(first) == found(done)


def test_changes_beside_the_graph_are_seen(spark, done):
    """What rules read beside modules and dependencies, and the configuration, ends their partitions."""
    import dataclasses

    cache, c = incremental.RuleCache(), config.from_dict(CONFIG)
    incremental.reanalyze(done.frames, c, cache)
    every = done.frames.modules.select("package").distinct()
    declared = every.crossJoin(every.withColumnRenamed("package", "dependency"))
    changed = dataclasses.replace(done.frames, declared=declared)
    some = done.frames.files.select("path").limit(1)
    again, stats = incremental.reanalyze(changed, c, cache, affected=some)
    full, _ = incremental.reanalyze(changed, c, incremental.RuleCache())
    assert (stats.rules_full, stats.rules_reused) == (1, 20)
    assert found(again) == found(full)
    other = config.from_dict(CONFIG | {"rules": {"ARCH-007": {"max_fan_out": 1}}})
    assert incremental.reanalyze(changed, other, cache)[1].rules_reused == 0


def test_relation_hash_counts_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    same = df.orderBy(F.desc("x"))
    assert incremental.relation_hash(df) == incremental.relation_hash(same)
    pairs = [spark.createDataFrame([(k, "a"), (k, "a")], "x int, y string") for k in (1, 2)]
    assert incremental.relation_hash(pairs[0]) != incremental.relation_hash(pairs[1])


def test_parse_cache(spark, tmp_path):
    at = Store(spark, f"file://{tmp_path}/cache")
    files = spark.createDataFrame([(f"src/m{i}.ts", f"import './m{i + 1}'") for i in range(6)], "path string, source string")
    parse = incremental.cached_parser(at)
    first = {r.path: r for r in parse(files).collect()}
    edited = files.withColumn("source", F.when(F.col("path") == "src/m2.ts", F.lit("import 'x'")).otherwise(F.col("source"))).where("path != 'src/m5.ts'")
    kept, todo = incremental.reusable(at.table("parsed"), edited)
    assert kept.count() == 4 and [r.path for r in todo.collect()] == ["src/m2.ts"]
    second = {r.path: r for r in parse(edited).collect()}
    assert second["src/m2.ts"].imports[0].specifier == "x"
    assert {p: r for p, r in second.items() if p != "src/m2.ts"} == {p: r for p, r in first.items() if p not in ("src/m2.ts", "src/m5.ts")}
    assert at.refresh().table("parsed").count() == 7 and at.state["generation"] == 2  # one row appended
    parse(edited.limit(2))
    assert at.state["generation"] == 2  # nothing to parse, nothing written
    parse(edited.where("path = 'src/m2.ts'").withColumn("source", F.lit("import 'y'")))
    assert at.table("parsed").count() == 1  # most of what was kept is gone


def test_store_keeps_whole_generations(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    store = Store(spark, at)
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    store.commit({"a": rows(1, 2), "b": rows(5)}, environment="e")
    broken = rows(0).select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": broken})
    again = Store(spark, at)
    assert (again.facts, again.state["generation"], sorted(r.x for r in again.table("a").collect())) == ({"environment": "e"}, 1, [1, 2])
    for k in range(10):
        again.commit({}, {"a": rows(10 + k)})
    assert sorted(r.x for r in store.refresh().table("a").collect()) == [1, 2, *range(10, 20)]
    assert len(store.state["tables"]["a"]["parts"]) < 8 and store.table("b").count() == 1 and store.table("none") is None
    assert sum(n.startswith("generation-") for n in os.listdir(tmp_path / "store")) == 2
    other = Store(spark, at)
    store.commit({"b": rows(6)})
    with pytest.raises(Exception, match="already exists"):
        other.commit({"b": rows(7)})


def test_restored_resolutions(spark, done, tmp_path):
    """After any change of files, imports or settings the answers are those of a full run."""
    inputs, c = done.frames.extra["inputs"], config.from_dict(CONFIG)
    manifests, tsconfigs, scopes = repository.manifests(spark, inputs), repository.tsconfigs(spark, inputs), repository.scopes(inputs)
    imports = done.frames.extra["imports"]
    files = done.frames.extra["every"]
    store = Store(spark, f"file://{tmp_path}/resolutions")

    def same(imports, files, environment="e"):
        found, stats = restore.restored(store, imports, files, manifests, tsconfigs, scopes, c, environment)
        want = resolve.resolve(imports, files, manifests, tsconfigs, scopes, c)
        assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
        return stats

    n = same(imports, files).new
    assert n > 5
    assert same(imports, files).resolved == 0
    lost = files.unionByName(spark.createDataFrame([("packages/web/src/app/lost.ts",)], "path string"))
    assert 0 < same(imports, lost).affected < n
    hit = done.frames.extra["found"].where("outcome = 'module'").first().value
    assert 0 < same(imports, files.where(F.col("path") != hit)).affected < n
    more = imports.unionByName(imports.limit(1).withColumn("specifier", F.lit("./quite/new")))
    stats = same(more, files)
    assert stats.new == 1 and stats.affected > 0
    assert same(imports.limit(0), files.limit(0)).new == 0
    assert same(imports, files, "other").new == n


def test_second_check_resolves_nothing_again(spark, root, tmp_path):
    import shutil

    own = f"{tmp_path}/tree"
    shutil.copytree(root, own)
    first = analyze.check(spark, own, config.from_dict(CONFIG), cache=f"file://{tmp_path}/cache")
    again = analyze.check(spark, own, config.from_dict(CONFIG), cache=f"file://{tmp_path}/cache")
    assert found(first) == found(again) and first.timings["resolved_again"] > 0 and again.timings["resolved_again"] == 0


def test_sessions():
    s = incremental.Sessions(most=2, ttl_s=10)
    assert [s.get(k, lambda k=k: k, now=t) for k, t in (("a", 0), ("b", 1), ("a", 2), ("c", 3))] == ["a", "b", "a", "c"]
    assert list(s.kept) == ["a", "c"]
    s.get("d", lambda: "d", now=20)
    assert list(s.kept) == ["d"]


def test_changes(spark):
    rows = {(r.path, r.status) for r in repository.changes(spark, ["M\ta.ts", "R100\told.ts\tnew.ts", "D\tx.ts", "new2.ts"]).collect()}
    assert rows == {("a.ts", "M"), ("old.ts", "D"), ("new.ts", "A"), ("x.ts", "D"), ("new2.ts", "A")}


def test_overlay_source(spark, done):
    over = spark.createDataFrame([("packages/web/src/shared/c.ts", "export const c = 2;"), ("new.ts", "1")], "path string, source string")
    got = repository.overlaid(done.frames.files, over)
    assert got.count() == done.frames.files.count() + 1
    assert {(r.path, r.status) for r in incremental.overlay_changes(got, done.frames.files).collect()} == {("packages/web/src/shared/c.ts", "M"), ("new.ts", "A")}


def test_streaming_feed(spark, done, tmp_path):
    from lattiq.streaming.changes import on_changes, settled

    at = tmp_path / "feed"
    spark.createDataFrame([("packages/web/src/shared/b.ts", "M", "2024-01-01 00:00:01"), ("packages/web/src/shared/b.ts", "D", "2024-01-01 00:00:02")], "path string, status string, ts string").selectExpr("path", "status", "cast(ts as timestamp) ts").write.parquet(str(at))
    feed = spark.readStream.schema("path string, status string, ts timestamp").parquet(str(at))
    seen = []
    q = on_changes(feed.select("path", "status"), lambda _: done.frames, config.from_dict(CONFIG), lambda df, n: seen.append((n, df.count())), f"t{tmp_path.name}")
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, done.diagnostics.count())]
    assert settled(feed).isStreaming


def test_cli(spark, root, capsys):
    assert cli.main(["check", "--root", root, "--format", "json"], spark) == cli.VIOLATIONS
    assert json.loads(capsys.readouterr().out)["diagnostics"]
    assert cli.main(["rules", "ARCH-001"], spark) == cli.OK
    assert cli.main(["config", "--root", root, "validate"], spark) == cli.OK
    assert cli.main(["nope"], spark) == cli.USAGE
    assert cli.main(["graph", "--root", root, "--module", "zz"], spark) == cli.USAGE
    assert cli.main(["discover", "--root", root], spark) == cli.OK
